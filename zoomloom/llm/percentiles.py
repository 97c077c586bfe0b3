"""Exact percentiles per group over very many numbers: distributed multi-select with mergeable summaries.

Plan
1. Every partition sorts its values per (group, measure) and writes them as *sorted runs* to the shared folder, each with its local
   quantiles. A run holds at most RUN values, so no row grows with the group, and no group gathers in a task.
2. Each round, every run proposes the local quantiles (medians of equal parts) of what is still in question for a target, each with the
   number of values it stands for. Proposals are merged in a tree, at most MERGED a target at any node. Their weighted quantile at the
   wanted rank becomes the pivot, and those as far to both sides as the proposals may be off become a bracket around it.
3. The runs count three ways (below, equal, above) around bracket and pivot by binary search; ranges that cannot hold the wanted
   value are discarded, and what is left of the runs is written anew for the next round. This repeats per group until it is found.
   Counts are exact, so the merged proposals only set the pace, never the result.

Summaries are the proposals kept: mergeable across partitions and days, with a stated error bound. The state of the search is a
table, not driver memory: groups may be many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoomloom.session import discard, materialize

RUN = 65_536
CHUNK = 2_000_000  # rows sorted at once
PROPOSALS = 128
MERGED = 1_024  # points of a merged list of proposals or summaries
FAN_IN = 32  # lists merged by one row of the tree
MAX_ROUNDS = 64

LIST = T.ArrayType(T.DoubleType())
COUNTS = T.ArrayType(T.LongType())


def local_quantiles(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` (value, weight) pairs of a sorted array; each value is the median of the part that it stands for."""
    n = len(values)
    if n <= most:
        return values, np.ones(n, dtype=np.int64)
    edges = np.linspace(0, n, most + 1).astype(np.int64)
    return values[(edges[:-1] + edges[1:] - 1) // 2], np.diff(edges)


def slack_of(weights: np.ndarray) -> int:
    """How far ranks read from the points may be off: half the greatest weight."""
    return int(weights.max()) // 2 if len(weights) else 0


def merged_points(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted (values, weights) of at most `most` points and the slack this adds: a point is the weighted median of its part."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    v, w = v[first], np.add.reduceat(w, first) if len(v) else w
    if len(v) <= most:
        return v, w, 0
    upto = np.cumsum(w)
    part = ((upto - (w + 1) // 2) * most // upto[-1]).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
    sums = np.add.reduceat(w, starts)
    middle = np.searchsorted(upto, upto[starts] - w[starts] + (sums + 1) // 2, "left")
    # a part of one point stays exact
    return v[middle], sums, int(np.where(np.diff([*starts, len(v)]) > 1, sums, 0).max()) // 2


def _lists(b: pa.RecordBatch, name: str):
    """The lists of a column as arrays."""
    c = b.column(b.schema.get_field_index(name))
    flat, off = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(off, off[1:])]


def _column(b: pa.RecordBatch, name: str):
    return b.column(b.schema.get_field_index(name))


def _list_array(arrays: list[np.ndarray], kind) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def sorted_runs(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys..., measure, n, points, weights, vals): sorted values of each partition, in runs of at most RUN values.

    points and weights are the local quantiles of the run. Null and NaN values are left out. Rows with a null key form a group of their
    own. A task sorts CHUNK rows at a time.
    """
    fields = [df.schema[k] for k in keys]
    schema = T.StructType(fields + [T.StructField("measure", T.StringType()), T.StructField("n", T.LongType()), T.StructField("points", LIST), T.StructField("weights", COUNTS), T.StructField("vals", LIST)])

    def chunk(held):
        import pyarrow.compute as pc

        t = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(t.num_rows, dtype=np.int64)
        for k in keys:  # one code per group within the chunk; groups are told apart by their Arrow values
            d = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code, return_inverse=True)[1]
        for m in measures:
            v = pc.fill_null(t[m].cast(pa.float64()), float("nan")).to_numpy()
            at = np.flatnonzero(~np.isnan(v))
            order = at[np.lexsort((v[at], code[at]))]
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            edges = [(s, min(s + RUN, hi)) for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]) for s in range(lo, hi, RUN)]
            for i in range(0, len(edges), 1_000):
                some = edges[i : i + 1_000]
                runs = [v[order[a:b]] for a, b in some]
                proposed = [local_quantiles(r, PROPOSALS) for r in runs]
                first = pa.array(order[[a for a, _ in some]])
                yield pa.RecordBatch.from_arrays(
                    [t[k].combine_chunks().take(first) for k in keys]
                    + [pa.array([m] * len(some)), pa.array([b - a for a, b in some], pa.int64()), _list_array([p for p, _ in proposed], pa.float64()), _list_array([w for _, w in proposed], pa.int64()), _list_array(runs, pa.float64())],
                    names=schema.names,
                )

    def build(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= CHUNK:
                yield from chunk(held)
                held, rows = [], 0
        if held:
            yield from chunk(held)

    return df.select(*keys, *measures).mapInArrow(build, schema)


def merge_tree(lists: DataFrame, ids: list[str], most: int, widest: int) -> DataFrame:
    """One (ids..., points, weights, slack) a group of ids, whose lists may be many: `widest` at most in one group.

    A task merges what it reads, then about FAN_IN lists of a group at a time, level by level, each cut down to `most` points. slack
    bounds the error of ranks read from the result: that of the lists and of all merges, added up.
    """
    fields = [lists.schema[k] for k in ids]
    schema = T.StructType([*fields, T.StructField("points", LIST), T.StructField("weights", COUNTS), T.StructField("slack", T.LongType()), T.StructField("part", T.IntegerType())])

    def fold(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}
        size = 0

        def give():
            entries = [(k, *merged_points(np.concatenate(v), np.concatenate(w), most), s) for k, (v, w, s) in held.items()]
            for i in range(0, len(entries), 1_000):
                some = entries[i : i + 1_000]
                keys = [pa.array([e[0][c] for e in some], type=kinds[c]) for c in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*keys, _list_array([e[1] for e in some], pa.float64()), _list_array([e[2] for e in some], pa.int64()), pa.array([e[3] + e[4] for e in some], pa.int64()), pa.array([part] * len(some), pa.int32())], names=schema.names)

        kinds = None
        for b in batches:
            kinds = [_column(b, k).type for k in ids]
            for key, v, w, s in zip(zip(*[_column(b, k).to_pylist() for k in ids]), _lists(b, "points"), _lists(b, "weights"), _column(b, "slack").to_pylist()):
                one = held.setdefault(key, [[], [], 0])
                one[0].append(v)
                one[1].append(w)
                one[2] += s
                size += len(v)
            if size > 1_000_000:  # cut down, or, with very many groups, give away what is held
                size = 0
                for key, (v, w, s) in held.items():
                    v, w, more = merged_points(np.concatenate(v), np.concatenate(w), most)
                    held[key] = [[v], [w], s + more]
                    size += len(v)
                if size > 500_000:
                    yield from give()
                    held, size = {}, 0
        if held:
            yield from give()

    now = lists.select(*ids, "points", "weights", "slack").mapInArrow(fold, schema)
    while True:
        widest = -(-widest // FAN_IN)
        now = now.groupBy(*ids, F.pmod(F.xxhash64("part"), F.lit(widest)).cast("int").alias("part")).agg(F.flatten(F.collect_list("points")).alias("points"), F.flatten(F.collect_list("weights")).alias("weights"), F.sum("slack").alias("slack"))
        now = now.mapInArrow(lambda batches: _cut_down(batches, ids, most), schema)
        if widest <= 1:
            return now.drop("part")


def _cut_down(batches, ids: list[str], most: int):
    for b in batches:
        out = [merged_points(v, w, most) for v, w in zip(_lists(b, "points"), _lists(b, "weights"))]
        slack = _column(b, "slack").to_numpy() + np.array([s for _, _, s in out], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*[_column(b, k) for k in ids], _list_array([v for v, _, _ in out], pa.float64()), _list_array([w for _, w, _ in out], pa.int64()), pa.array(slack), _column(b, "part")],
            names=[*ids, "points", "weights", "slack", "part"],
        )


def summarize(runs: DataFrame, keys: list[str], points: int = 1000) -> DataFrame:
    """Mergeable summaries (keys..., measure, n, slack, points, weights) with at most `points` points for each run.

    A point is the median of the values it stands for, so in one run the rank of any value is off by at most half the
    largest weight, the slack. Read from a union of summaries it is off by at most the sum of their slacks: a share of
    1 / (2 * points) of all values; summaries of runs of up to `points` values are exact.
    """
    schema = T.StructType([runs.schema[k] for k in keys] + [T.StructField("measure", T.StringType()), T.StructField("n", T.LongType()), T.StructField("slack", T.LongType()), T.StructField("points", LIST), T.StructField("weights", COUNTS)])

    def build(batches):
        for b in batches:
            got = [local_quantiles(v, points) for v in _lists(b, "vals")]
            yield pa.RecordBatch.from_arrays(
                [*[_column(b, k) for k in [*keys, "measure", "n"]], pa.array([slack_of(w) for _, w in got], pa.int64()), _list_array([v for v, _ in got], pa.float64()), _list_array([w for _, w in got], pa.int64())], names=schema.names
            )

    return runs.select(*keys, "measure", "n", "vals").mapInArrow(build, schema)


def read_summaries(summaries: DataFrame, by: list[str], shares: list[float], most: int = 4 * MERGED) -> DataFrame:
    """Percentiles of the union of summaries per (by..., measure): (by..., measure, share, n, value, rank_error).

    rank_error bounds how many values may lie between the value given and the exact one. Summaries of days, partitions or runs combine in
    a tree (merge_tree), so no row or task holds all points of a group; each merge adds at most its share of 1 / (2 * most).
    """
    ids = [*by, "measure"]
    totals = materialize(summaries.groupBy(*ids).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lists")))
    widest = totals.agg(F.max("lists")).first()[0] or 1
    merged = merge_tree(summaries, ids, most, widest)
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    asked = totals.select(*ids, "n", wanted).withColumn("need", _rank(F.col("n"), F.col("share")))
    both = _beside(asked, merged, ids)
    return _read(both, [*ids, "share", "n"], least=True)


def _beside(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Inner join on ids, nulls alike, that keeps the ids of the left."""
    r = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(ids)], *[c for c in right.columns if c not in ids])
    cond = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(ids)]
    return left.join(r, cond).drop(*[f"__r{i}" for i in range(len(ids))])


def _read(both: DataFrame, keep: list[str], least: bool = False) -> DataFrame:
    """Read the needed rank from the points of each row: value and rank_error, or left, pivot and right (null: none)."""
    out = ["value"] if least else ["left", "pivot", "right"]
    schema = T.StructType([both.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in out] + ([T.StructField("rank_error", T.LongType())] if least else []))

    def read(batches):
        for b in batches:
            need, slack = _column(b, "need").to_numpy(), _column(b, "slack").to_numpy()
            cols = [[] for _ in out]
            for v, w, r, s in zip(_lists(b, "points"), _lists(b, "weights"), need.tolist(), slack.tolist()):
                upto = np.cumsum(w)
                at = min(int(np.searchsorted(upto, r, "left")), len(v) - 1)
                if least:
                    cols[0].append(float(v[at]))
                    continue
                lo, hi = int(np.searchsorted(upto, r - s, "right")) - 1, int(np.searchsorted(upto, r + s, "left"))
                cols[0].append(float(v[lo]) if lo >= 0 else None)
                cols[1].append(float(v[at]))
                cols[2].append(float(v[hi]) if hi < len(v) else None)
            yield pa.RecordBatch.from_arrays([*[_column(b, c) for c in keep], *[pa.array(c, pa.float64()) for c in cols], *([pa.array(slack)] if least else [])], names=schema.names)

    return both.mapInArrow(read, schema)


def _rank(n, share):
    """The least whole rank that is at least the share of n; guarded against the noise of the product."""
    return F.greatest(F.lit(1), F.ceil(n * share - n * F.lit(1e-12) - F.lit(1e-9))).cast("long")


def multi_select(runs: DataFrame, keys: list[str], targets: list[tuple[str, float]], proposals: int = PROPOSALS) -> DataFrame:
    """Exact percentiles: (keys..., measure, share, n, value) for every group and every (measure, share) of targets.

    value is the smallest v such that at least the share of the group's values of that measure are <= v; infinite values count
    like any other. Groups without a value of the measure give no row. Ties and repeated values count as often as they occur. A target
    that got lost on the way is an error, never a missing row.
    """
    spark = runs.sparkSession
    wanted = spark.createDataFrame([(m, float(s)) for m, s in dict.fromkeys(targets)], "measure string, share double")
    ids = [*keys, "measure"]
    sizes = runs.groupBy(*ids).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lists"))
    none = F.lit(None).cast("double")
    state = sizes.join(F.broadcast(wanted), "measure")  # one row a target
    # the values in question: lo < v < hi; a null bound is none
    state = materialize(state.select(*ids, "share", "n", "lists", _rank(F.col("n"), F.col("share")).alias("rank"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), none.alias("value")))
    cols = state.columns
    at = ids  # the columns that tell the rows of `source` apart: all targets of a group share its runs at first
    source = runs.select(*ids, "points", "weights", (F.array_max("weights") / 2).cast("long").alias("slack"), "vals")
    told = state.agg(F.count(F.lit(1)), F.max("lists")).first()
    total, widest = told[0], told[1] or 1
    done = None
    for _ in range(MAX_ROUNDS):
        if not total:
            return (state if done is None else done).where(F.col("value").isNotNull()).select(*ids, "share", "n", "value")
        merged = merge_tree(source, at, 8 * proposals, widest)
        asked = _beside(state.where(F.col("value").isNull()).withColumn("need", F.col("rank") - F.col("below")), merged, at)
        pivots = materialize(_read(asked, cols))
        fresh = materialize(_counted(source, pivots, at, cols))
        found = fresh.where(F.col("value").isNotNull())
        done = found if done is None else done.unionByName(found)
        told = fresh.agg(F.count(F.lit(1)), F.count("value")).first()
        if told[0] != total:
            raise RuntimeError(f"{total - told[0]} percentiles got lost")
        total = told[0] - told[1]
        if total:
            narrowed = materialize(_narrowed(source, fresh.where(F.col("value").isNull()), at, proposals))
            discard(source)
            source, at = narrowed, [*ids, "share"]
        discard(pivots)
        state = fresh
    raise RuntimeError("multi_select did not end")


def _counted(source: DataFrame, pivots: DataFrame, at: list[str], cols: list[str]) -> DataFrame:
    """Count below, equal and above of left, pivot and right, and keep the range that holds the wanted rank."""
    cuts = F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("left", "pivot", "right")))))
    both = _beside(source.select(*at, "vals"), pivots.groupBy(*at).agg(F.array_sort(cuts).alias("cuts")), at)
    schema = T.StructType([source.schema[c] for c in at] + [T.StructField("cut", T.DoubleType()), T.StructField("lt", T.LongType()), T.StructField("le", T.LongType())])

    def count(batches):
        for b in batches:
            cuts, lt, le = _lists(b, "cuts"), [], []
            for v, c in zip(_lists(b, "vals"), cuts):
                lt.append(np.searchsorted(v, c, "left"))
                le.append(np.searchsorted(v, c, "right"))
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in cuts]))
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (cuts, lt, le)]
            yield pa.RecordBatch.from_arrays([*[_column(b, c).take(row) for c in at], pa.array(flat[0], pa.float64()), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.int64))], names=schema.names)

    counts = both.mapInArrow(count, schema).groupBy(*at, "cut").agg(F.sum("lt").alias("lt"), F.sum("le").alias("le"))
    each = pivots.select(*cols, F.explode(F.array_distinct(F.array_compact(F.array("left", "pivot", "right")))).alias("cut"))
    told = _beside(each, counts, [*at, "cut"]).withColumns({"lt": F.col("lt") + F.col("below"), "le": F.col("le") + F.col("below")})
    rank = F.col("rank")
    under = F.max(F.when(F.col("le") < rank, F.struct("cut", "le")))  # the greatest cut below the wanted value
    over = F.min(F.when(F.col("lt") >= rank, F.col("cut")))
    hit = F.max(F.when((F.col("lt") < rank) & (rank <= F.col("le")), F.col("cut")))
    now = told.groupBy(*[c for c in cols if c != "value"]).agg(hit.alias("value"), under.alias("u"), over.alias("o"))
    return now.withColumns({"lo": F.coalesce("u.cut", "lo"), "below": F.coalesce("u.le", "below"), "hi": F.coalesce("o", "hi")}).select(*cols)


def _narrowed(source: DataFrame, state: DataFrame, at: list[str], most: int) -> DataFrame:
    """What each run still has in question, a row for each open target: (ids..., share, points, weights, slack, vals)."""
    open_ = state.groupBy(*at).agg(F.collect_list(F.struct(F.col("share").alias("s"), "lo", "hi")).alias("targets")) if "share" not in at else state.select(*at, F.array(F.struct(F.col("share").alias("s"), "lo", "hi")).alias("targets"))
    both = _beside(source.select(*at, "vals"), open_, at)
    ids = [c for c in at if c != "share"]
    schema = T.StructType([source.schema[c] for c in ids] + [T.StructField("share", T.DoubleType()), T.StructField("points", LIST), T.StructField("weights", COUNTS), T.StructField("slack", T.LongType()), T.StructField("vals", LIST)])

    def narrow(batches):
        for b in batches:
            rows, shares, parts = [], [], []
            for i, (v, ts) in enumerate(zip(_lists(b, "vals"), _column(b, "targets").to_pylist())):
                for t in ts:
                    left = v[0 if t["lo"] is None else np.searchsorted(v, t["lo"], "right") : len(v) if t["hi"] is None else np.searchsorted(v, t["hi"], "left")]
                    if len(left):
                        rows.append(i)
                        shares.append(t["s"])
                        parts.append(left)
            got = [local_quantiles(v, most) for v in parts]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[_column(b, c).take(take) for c in ids], pa.array(shares, pa.float64()), _list_array([v for v, _ in got], pa.float64()), _list_array([w for _, w in got], pa.int64()), pa.array([slack_of(w) for _, w in got], pa.int64()), _list_array(parts, pa.float64())],
                names=schema.names,
            )

    return both.mapInArrow(narrow, schema)
