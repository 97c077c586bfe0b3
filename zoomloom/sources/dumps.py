"""Plain-text database dumps as tables: CREATE TABLE statements, COPY ... FROM stdin blocks and INSERT statements.

A dump of any size is read by Spark as lines. Only the lines that begin or end a statement, a few a table, come to the driver; rows belong to the
block whose first and last line they lie between, by the place of their file block and their number in it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CREATE = r"^CREATE (?:UNLOGGED )?TABLE (?:IF NOT EXISTS )?\S+ \("
_COPY = r"^COPY \S+ ?\(.*\) FROM stdin;$"
_INSERT = r"^INSERT INTO \S+"
_ENDS = r"^(\\\.|\).*;)$"
#: types of columns by the first word of their declaration; all others are text
TYPES = {"smallint": "int", "integer": "int", "int": "int", "int4": "int", "serial": "int", "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "numeric": "double", "decimal": "double", "double": "double", "real": "double", "float": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz"}


def _plain(name: str) -> str:
    """A table's or column's name without schema and quotes."""
    return name.split(".")[-1].strip().strip('"`')


def columns_of(lines: list[str]) -> dict[str, str]:
    """Names and types of the columns that the lines of a CREATE TABLE statement declare; constraints are left out."""
    body = " ".join(lines)
    body = body[body.index("(") + 1 : body.rindex(")")]
    parts, depth, at = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(body[at:i])
            at = i + 1
    out = {}
    for p in [*parts, body[at:]]:
        words = p.split()
        if len(words) > 1 and words[0].upper() not in ("CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "KEY", "INDEX", "EXCLUDE"):
            out[_plain(words[0])] = TYPES.get(re.split(r"\W", words[1].lower())[0], "string")
    return out


def _copied(text: Column) -> Column:
    """A field of a COPY line: \\N is null, escapes are undone."""
    done = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        done = F.replace(done, F.lit(a), F.lit(b))
    return F.when(text != "\\N", done)


def insert_rows(line: str) -> list[list[str | None]]:
    """The rows of an INSERT statement of one line; quotes are doubled inside texts, NULL is null."""
    at = line.upper().index("VALUES") + 6
    rows, row, field, quoted, text, depth = [], [], "", False, False, 0
    while at < len(line):
        c = line[at]
        if quoted:
            if c == "'" and line[at + 1 : at + 2] == "'":
                field, at = field + "'", at + 1
            elif c == "'":
                quoted = False
            else:
                field += c
        elif c == "'":
            field = field if text else ""  # blanks before it
            quoted = text = True
        elif c == "(":
            depth += 1
        elif c in ",)" and depth:
            value = field if text else field.strip()
            row.append(value if text or value.upper() != "NULL" else None)
            field, text = "", False
            if c == ")":
                depth -= 1
                rows.append(row)
                row = []
        elif depth and not (text and c.isspace()):
            field += c
        at += 1
    return rows


def load_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump, each registered as a view. Columns that no CREATE TABLE declares are text; statements of other kinds are passed over.

    A COPY row is one line; an INSERT statement is one line. Rows with too few fields are filled with nulls.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    marks = lines.where(F.col("value").rlike("|".join((_CREATE, _COPY, _ENDS)))).orderBy("at").collect()  # a few a table
    kinds: dict[str, dict[str, str]] = {}
    blocks: dict[str, list[tuple]] = {}
    open_ = None
    for m in marks:
        v, at = m["value"], m["at"]
        if open_ is None and re.match(_COPY, v):
            name, fields = re.match(r"^COPY (\S+?) ?\((.*)\) FROM", v).groups()
            open_ = ("copy", _plain(name), [_plain(f) for f in fields.split(",")], at)
        elif open_ is None and re.match(_CREATE, v):
            open_ = ("create", _plain(re.match(r"^CREATE .*?TABLE (?:IF NOT EXISTS )?(\S+) \(", v).group(1)), None, at)
        if open_ and open_[0] == "copy" and v == "\\.":
            blocks.setdefault(open_[1], []).append((open_[2], open_[3], at))
            open_ = None
        elif open_ and open_[0] == "create" and v.rstrip().endswith(";"):
            some = lines.where((F.col("at") >= _place(open_[3])) & (F.col("at") <= _place(at))).orderBy("at").collect()  # one statement
            kinds[open_[1]] = columns_of([r["value"] for r in some])
            open_ = None
    inserted = lines.where(F.col("value").rlike(_INSERT)).select(F.regexp_extract("value", r"^INSERT INTO (\S+)", 1).alias("name"), "value")
    for r in inserted.select("name").distinct().collect():  # one row a table
        kinds.setdefault(_plain(r["name"]), {})
    out = {}
    for name in dict.fromkeys([*kinds, *blocks]):
        known = kinds.get(name) or {c: "string" for fields, _, _ in blocks.get(name, []) for c in fields}
        parts = [_read_copy(lines, b, known) for b in blocks.get(name, [])]
        own = inserted.where(F.regexp_replace(F.substring_index("name", ".", -1), '["`]', "") == name)
        if known:
            parts.append(_read_inserts(own, known))
        if parts:
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            df.createOrReplaceTempView(name)
            out[name] = df
    return out


def _place(at) -> Column:
    return F.struct(F.lit(at["f"]).alias("f"), F.lit(at["b"]).alias("b"), F.lit(at["i"]).alias("i"))


def _read_copy(lines: DataFrame, block: tuple, kinds: dict[str, str]) -> DataFrame:
    fields, first, last = block
    rows = lines.where((F.col("at") > _place(first)) & (F.col("at") < _place(last))).select(F.split("value", "\t").alias("p"))
    at = {c.lower(): i for i, c in enumerate(fields)}
    cells = [_copied(F.get("p", F.lit(at[c.lower()]))) if c.lower() in at else F.lit(None) for c in kinds]
    return rows.select(*[v.cast(t).alias(c) for v, (c, t) in zip(cells, kinds.items())])


def _read_inserts(inserted: DataFrame, kinds: dict[str, str]) -> DataFrame:
    names = list(kinds)

    def parse(batches):
        for b in batches:
            cells: list[list] = [[] for _ in names]
            for line in b.column(0).to_pylist():
                told = re.match(r"^INSERT INTO \S+\s*\(([^)]*)\)\s*VALUES", line, re.I)
                at = {_plain(c).lower(): i for i, c in enumerate(told.group(1).split(","))} if told else {c.lower(): i for i, c in enumerate(names)}
                for row in insert_rows(line):
                    for k, c in enumerate(names):
                        i = at.get(c.lower())
                        cells[k].append(row[i] if i is not None and i < len(row) else None)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in cells], names=names)

    text = inserted.select("value").mapInArrow(parse, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return text.select(*[F.col(c).cast(t) for c, t in kinds.items()])
