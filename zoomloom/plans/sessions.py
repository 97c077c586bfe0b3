"""Queries through the engine: projects and templates are loaded, fetched, moved over and changed as a client would, over whole tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.engine import Engine
from zoomloom.functions import scales
from zoomloom.operators import mutations, pyramid, viewport
from zoomloom.operators.placement import Placement
from zoomloom.plans import fetch, pyramids, shows
from zoomloom.session import shared_dir, table
from zoomloom.sources import dumps, readers, sinks, synthetic
from zoomloom.spec.model import LITERAL_IN, LITERAL_OUT, Canvas, Jump, Layer, Project, Transform, View
from zoomloom.spec.predicates import Equals
from zoomloom.spec.templates import ChartTemplate, MapTemplate, PyramidTemplate, TableTemplate, add_chart, add_map, add_pyramid, add_table


def _engine(spark: SparkSession, log: bool = False) -> Engine:
    return Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", log)


def _items(spark: SparkSession, d: str, log: bool = False) -> Engine:
    """lineitem on two canvases joined by literal zooms, as a box layer and a tiled one."""
    placed = table(spark, d, "lineitem").withColumns({"px": scales.linear(F.col("l_extendedprice"), (0, 100_000), (0, 10_000)), "py": scales.linear(F.col("l_quantity"), (0, 50), (0, 5_000))})
    placed.withColumns({"px2": F.col("px") * 2, "py2": F.col("py") * 2}).createOrReplaceTempView("items_on_canvas")
    p = Project("items")
    rows = Transform("SELECT * FROM items_on_canvas", filterable=("l_returnflag", "l_linestatus"))
    deep = Placement("col:px2", "col:py2", "con:40", "con:20")
    p.add_canvas(Canvas("top", 10_000, 5_000, (Layer(rows, placement=fetch.MARKS), Layer(rows, placement=fetch.MARKS, fetching="tiling"))))
    p.add_canvas(Canvas("deep", 20_000, 10_000, (Layer(rows, placement=deep, layout="strip"),)))
    p.add_view(View("v", 1000, 800, "top", 3000, 2000, {"layer0": {"==": ["l_returnflag", "R"]}}))
    p.add_jump(Jump("top", "deep", LITERAL_IN))
    p.add_jump(Jump("deep", "top", LITERAL_OUT))
    e = _engine(spark, log)
    e.load(p)
    return e


def engine_first(spark, d):
    """The first state of a view: its canvas, corner and predicate."""
    return _items(spark, d).first("v")["rows"][0].select(*fetch.KEYS, "l_returnflag")


def engine_pan(spark, d):
    """What a client holds after two pans, the second fetched as a delta."""
    e = _items(spark, d)
    e.pan("top", 2500, 1200, "v")
    return e.pan("top", 2900, 1500, "v")[0].select(*fetch.KEYS)


def engine_zoom(spark, d):
    """A literal zoom keeps the middle of the viewport where it is."""
    e = _items(spark, d)
    e.pan("top", 2900, 1500, "v")
    return e.zoom("v", True)[0].select(*fetch.KEYS, F.round("cx", 6).alias("cx"))


def engine_log(spark, d):
    """The log of two pans and a tile: fetches and rows by kind."""
    e = _items(spark, d, True)
    e.pan("top", 2500, 1200, "v")
    e.pan("top", 2900, 1500, "v")
    e.tile("top", 2048, 1024)
    e.flush_log()
    return sinks.fetch_statistics(spark.read.parquet(f"{e.folder}/stats")).select("query_type", "fetches", "rows")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumns({"px": scales.linear(F.col("o_totalprice"), (0, 500_000), (0, 10_000)), "py": F.pmod("o_custkey", F.lit(5000)).cast("double")})


def engine_jump(spark, d):
    """A jump to the orders of one status, with one order in the middle of the viewport."""
    e = _items(spark, d)
    _orders(spark, d).createOrReplaceTempView("orders_on_canvas")
    p = e.project
    p.add_canvas(Canvas("orders", 10_000, 5_000, (Layer(Transform("SELECT * FROM orders_on_canvas"), placement=fetch.MARKS),)))
    status = lambda row: {"layer0": {"==": ["o_orderstatus", row["o_orderstatus"]]}}
    middle = lambda row: {"centroid": {"layer0": {"==": ["o_orderkey", str(row["o_orderkey"])]}}}
    j = p.add_jump(Jump("top", "orders", "semantic_zoom", predicates=status, viewport=middle))
    e.load(p)
    e.pan("top", 0, 0, "v")
    row = table(spark, d, "orders").orderBy("o_orderkey").first().asDict()
    return e.trigger_jump(j, "v", row)[0].select("o_orderkey", "o_orderstatus")


def engine_table(spark, d):
    """The rows that a numbered table shows of one group, and the height of its canvas under the group's predicate."""
    _orders(spark, d).createOrReplaceTempView("orders_on_canvas")
    p = Project("table")
    c = add_table(p, TableTemplate("orders_on_canvas", ("o_orderkey", "o_totalprice"), "o_totalprice desc, o_orderkey", group_by=("o_orderstatus",)))
    p.add_view(View("v", 200, 700, c.id))
    e = _engine(spark)
    e.load(p)
    only = {0: e.predicate(c.id, 0, "(o_orderstatus='F')")}
    e._predicates[c.id, "v"] = only
    return e.pan(c.id, 0, 0, "v")[0].select("o_orderkey", "rn", "o_orderstatus", F.lit(e.size(c.id, only)[1]).alias("height"))


def engine_chart(spark, d):
    """A chart and its sample under a predicate, aggregated from the source."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    p = Project("chart")
    c = add_chart(p, ChartTemplate("SELECT * FROM orders", "bar", ("o_orderpriority",), "COUNT(*)", stack=("o_orderstatus",), sample=("o_orderkey",)))
    p.add_view(View("v", 500, 500, c.id))
    e = _engine(spark)
    e.load(p)
    only = {i: Equals("o_orderstatus", "F") for i in (0, 1)}
    bars, sample = e.canvas(c.id, only)[1].values()
    return bars.select("o_orderpriority", "agg_value", F.lit(None).cast("long").alias("o_orderkey")).unionByName(sample.select("o_orderpriority", F.lit(None).cast("long").alias("agg_value"), "o_orderkey"))


def _pyramid(spark: SparkSession, d: str) -> tuple[Engine, list[Canvas]]:
    pyramids.points(spark, d).createOrReplaceTempView("customers_on_plane")
    p = Project("pyramid")
    made = add_pyramid(p, PyramidTemplate(pyramids.DEEP, "SELECT * FROM customers_on_plane", functions=("sum",)))
    p.add_view(View("v", 500, 500, made[0].id))
    e = _engine(spark)
    e.load(p)
    return e, made


def engine_pyramid(spark, d):
    """The layers of all levels of a pyramid as they are stored: one row a cluster, with its head's columns and aggregates."""
    e, made = _pyramid(spark, d)
    out = None
    for level, c in enumerate(made):
        one = e.layer(c.id, 1).select(F.lit(level).alias("level"), F.col("c_custkey").alias("head"), F.col("cluster_agg")["count(*)"].cast("long").alias("n"), F.round(F.col("cluster_agg")["sum(c_acctbal)"] + 1e-9, 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def engine_ranges(spark, d):
    """The value ranges that the build of a pyramid keeps, read back by another session."""
    e, made = _pyramid(spark, d)
    later = Engine(spark, e.folder)
    later.project = e.project
    told = later.pyramid_information(made[0].id, 1)["ranges"]
    return spark.createDataFrame([(int(k), v["rough_n"], v["min_n"], v["max_n"]) for k, v in told.items()], "level int, rough_n long, min_n long, max_n long")


def engine_map(spark, d):
    """Both maps of a template: shapes on the canvas of the states and, enlarged, on that of the counties."""
    lon, lat = -120 + F.col("n_nationkey") * 2.0, 30 + F.col("n_nationkey") * 0.5
    corner = lambda a, b: F.array(lon + a, lat + b)
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).alias("coordinates")))
    table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_regionkey").alias("rate"), shape.alias("geomstr")).createOrReplaceTempView("nations_on_map")
    p = Project("map")
    states, counties = add_map(p, MapTemplate("nations_on_map", "rate", "nations_on_map", zoom_factor=4), 960, 500)
    p.add_view(View("v", 500, 400, states.id))
    e = _engine(spark)
    e.load(p)
    one, two = e.layer(states.id, 1), e.layer(counties.id, 2)
    parts = [t.select(F.lit(k).alias("map"), F.col("name").cast("int").alias("n_nationkey"), *[F.round(F.col(c) / f, 4).alias(c) for c in ("cx", "cy", "width", "height")]) for k, t, f in (("state", one, 1), ("county", two, 4))]
    return parts[0].unionByName(parts[1])


def engine_update(spark, d):
    """An update of a layer, seen in the layer and in its base table; the reverse function gives the base its price."""
    path = f"{shared_dir(spark)}/base-{uuid.uuid4().hex}"
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("orders_base")
    placed = "SELECT o_orderkey, o_orderstatus, o_totalprice / 50 AS px, CAST(o_custkey % 5000 AS DOUBLE) AS py FROM orders_base"
    p = Project("update")
    rows = Transform(placed, base=("orders_base", path), reverse={"o_totalprice": lambda df: df["px"] * 50})
    p.add_canvas(Canvas("c", 10_000, 5_000, (Layer(rows, placement=fetch.MARKS, updates=True),)))
    p.add_view(View("v", 500, 500, "c"))
    e = _engine(spark)
    e.load(p)
    e.update("c", 0, table(spark, d, "orders").where("o_orderkey % 97 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(10.0).alias("px")), ["o_orderkey"])
    base = spark.table("orders_base").select("o_orderkey", F.col("o_orderstatus").alias("base_status"), F.round("o_totalprice", 4).alias("base_price"))
    return e.layer("c", 0).select("o_orderkey", "o_orderstatus", F.round("px", 6).alias("px")).join(base, "o_orderkey")


def changed_rows(spark, d):
    """Rows removed, added and changed by two keys; a change names the columns that the table has."""
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kept = mutations.remove_rows(t, t.where("o_orderkey % 5 = 0"), ["o_orderkey"])
    more = mutations.insert_rows(kept, table(spark, d, "customer").where("c_acctbal < 0").select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), "c_name"))
    changes = t.where("o_custkey % 7 = 0").select("o_orderkey", "o_custkey", F.lit("S").alias("o_orderstatus"), F.lit(1).alias("other"))
    fields = mutations.changed_columns(changes.columns, t)
    return mutations.change_columns(mutations.update_rows(more, changes.select(*fields), ["o_orderkey", "o_custkey"]), {"even": F.col("o_custkey") % 2 == 0}, ["o_custkey"])


def leaf_route(spark, d):
    """Rows of a box, looked for in those leaves only that it touches."""
    splits = [1500.0, 3000.0, 5000.0]
    rows = viewport.by_leaf(fetch.items(spark, d), splits)
    return viewport.in_box(rows.where(F.col("leaf").isin(viewport.kd_route(splits, fetch.NEW, 20.0))), fetch.NEW).select(*fetch.KEYS)


def mark_thresholds(spark, d):
    """Least distance of marks of many sizes, on one machine and distributed, as the density bound gives it."""
    rows = [(w, h, pyramid.overlap_threshold(w, h, 0.0), pyramid.overlap_threshold(w, h, 0.0, distributed=True)) for w in range(5, 300, 11) for h in range(5, 300, 13)]
    return spark.createDataFrame(rows, "w int, h int, local double, distributed double")


def rows_as_text(spark, d):
    """Rows as a client gets them, read in batches: text, empty for null."""
    rows = [r for part in readers.rows_as_text(table(spark, d, "teams").select("id", "abbr", "city", "rank").where("id is not null").distinct(), 64) for r in part]
    return spark.createDataFrame(rows, "id string, abbr string, city string, rank string")


def dump_roundtrip(spark, d):
    """The suppliers, and beside them the nations, written as a database dump and loaded from it."""
    folder = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    head = ["CREATE TABLE public.supplier_d (", "    s_suppkey bigint NOT NULL,", "    s_name character varying(25),", "    s_nationkey integer,", "    s_acctbal double precision,", "    CONSTRAINT s_pk PRIMARY KEY (s_suppkey)", ");", "COPY public.supplier_d (s_suppkey, s_name, s_nationkey, s_acctbal) FROM stdin;"]
    tail = ["\\.", 'CREATE TABLE "nation_d" (n_nationkey int, n_name text);']
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\\N"))
    rows = table(spark, d, "supplier").select(F.lit(1).alias("k"), F.concat_ws("\t", *[cell(c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")]).alias("value"))
    inserts = table(spark, d, "nation").select(F.lit(3).alias("k"), F.concat(F.lit("INSERT INTO nation_d (n_name, n_nationkey) VALUES ('"), F.replace("n_name", F.lit("'"), F.lit("''")), F.lit("', "), F.col("n_nationkey").cast("string"), F.lit(");")).alias("value"))
    fixed = lambda k, lines: spark.createDataFrame([(k, i, v) for i, v in enumerate(lines)], "k int, i long, value string")
    every = fixed(0, head).unionByName(rows.withColumn("i", F.lit(0).cast("long"))).unionByName(fixed(2, tail)).unionByName(inserts.withColumn("i", F.lit(0).cast("long")))
    every.coalesce(1).sortWithinPartitions("k", "i").select("value").write.text(folder)
    found = dumps.load_dump(spark, folder)
    return found["supplier_d"].join(found["nation_d"], F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", "n_name")


def column_kinds(spark, d):
    """Names and types of the columns of a table, from its schema."""
    kinds = readers.column_types(table(spark, d, "lineitem"))
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    return spark.createDataFrame([(n, names[k]) for n, k in kinds.items()], "name string, kind string")


def kept_documents(spark, d):
    """A document for each nation, put twice; the later one counts."""
    folder = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    nations = [(r["n_name"], r["n_regionkey"]) for r in table(spark, d, "nation").collect()]  # a fixed table of 25 rows
    for version in (1, 2):
        for name, region in nations:
            sinks.save_document(spark, folder, name, {"region": region, "version": version})
    found = [(name, json.loads(json.dumps(sinks.load_document(spark, folder, name)))) for name, _ in nations]
    return spark.createDataFrame([(n, v["region"], v["version"]) for n, v in found], "n_name string, region int, version int")


def number_series(spark, d):
    return synthetic.series(spark, 1, 5000).select("n", (F.col("n") % 16).alias("hash_key"))


def ssv_hover(spark, d):
    """The box around the hull of every cluster."""
    boxes = pyramid.hover_box(pyramid.build_pyramid(pyramids.points(spark, d), pyramids.DEEP).hulls)
    return boxes.select("level", "head", *[F.round(c, 4).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


QUERIES = {f.__name__: f for f in (engine_first, engine_pan, engine_zoom, engine_log, engine_jump, engine_table, engine_chart, engine_pyramid, engine_ranges, engine_map, engine_update, changed_rows, leaf_route, mark_thresholds, rows_as_text, dump_roundtrip, column_kinds, kept_documents, number_series, ssv_hover)}


def _box(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"maxx >= {x0} AND minx <= {x1} AND maxy >= {y0} AND miny <= {y1}"


_FIRST, _SECOND = _box(2000, 800, 4000, 2400), _box(2400, 1100, 4400, 2700)
_DEEP = pyramids.levels_sql()

ORACLE = {
    "engine_first": fetch._ITEMS + f"SELECT l_orderkey, l_linenumber, l_returnflag FROM b WHERE {_box(2500, 1600, 4500, 3200)} AND l_returnflag = 'R'",
    "engine_pan": fetch._ITEMS + fetch._ID + _SECOND,
    "engine_zoom": """WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100000e0 * 10000e0 * 2 AS cx, l_quantity / 50e0 * 5000e0 * 2 AS cy FROM lineitem)
SELECT l_orderkey, l_linenumber, round(cx, 6) AS cx FROM b WHERE cx + 20 >= 5800 AND cx - 20 <= 7800 AND cy + 10 >= 3000 AND cy - 10 <= 4600""",
    "engine_log": fetch._ITEMS + f"""SELECT 'pan' AS query_type, CAST(2 AS BIGINT) AS fetches, (SELECT count(*) FROM b WHERE {_FIRST}) + (SELECT count(*) FROM b WHERE {_SECOND} AND NOT ({_FIRST})) AS rows
UNION ALL SELECT 'tile', 1, count(*) FROM b WHERE floor(minx / 1024) <= 2 AND floor(maxx / 1024) >= 2 AND floor(miny / 1024) <= 1 AND floor(maxy / 1024) >= 1""",
    "engine_jump": """WITH c AS (SELECT *, o_totalprice / 500000e0 * 10000e0 AS cx, CAST(o_custkey % 5000 AS DOUBLE) AS cy FROM orders), k AS (SELECT * FROM c WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)),
b AS (SELECT greatest(-10, cx - 1000) AS x0, greatest(-10, cy - 800) AS y0, o_orderstatus AS s FROM k), f AS (SELECT *, least(10010, x0 + 2000) AS x1, least(5010, y0 + 1600) AS y1 FROM b)
SELECT o_orderkey, o_orderstatus FROM c, f WHERE o_orderstatus = s AND cx + 20 >= x0 AND cx - 20 <= x1 AND cy + 10 >= y0 AND cy - 10 <= y1""",
    "engine_table": """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_orderstatus, count(*) OVER () * 40e0 + 50 AS height FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM n WHERE 50 + 40 * rn - 40 <= least(height + 10, 1390)""",
    "engine_chart": """SELECT * FROM (SELECT o_orderpriority, count(*) AS agg_value, CAST(NULL AS BIGINT) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL ORDER BY agg_value DESC, o_orderpriority LIMIT 25)
UNION ALL SELECT * FROM (SELECT o_orderpriority, NULL, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 75)""",
    "engine_pyramid": _DEEP + "SELECT level, head, count(*) AS n, round(sum(c_acctbal) + 1e-9, 4) AS total FROM m GROUP BY ALL",
    "engine_ranges": _DEEP + ", c AS (SELECT level, head, count(*) AS n FROM m GROUP BY ALL) SELECT level, count(*) AS rough_n, min(n) AS min_n, max(n) AS max_n FROM c GROUP BY ALL",
    "engine_map": f"WITH one AS ({shows.ORACLE['state_shapes']}) SELECT m AS map, one.* FROM one, (VALUES ('state'), ('county')) AS t(m)",
    "engine_update": """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN o_orderkey % 97 = 0 THEN 10e0 ELSE o_totalprice / 50 END, 6) AS px,
  CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS base_status, round(CASE WHEN o_orderkey % 97 = 0 THEN 500e0 ELSE o_totalprice END, 4) AS base_price FROM orders""",
    "changed_rows": """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'S' ELSE o_orderstatus END AS o_orderstatus, o_custkey % 2 = 0 AS even FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT -c_custkey, 'N', c_custkey % 2 = 0 FROM customer WHERE c_acctbal < 0""",
    "leaf_route": fetch._ITEMS + fetch._ID + fetch._IN_NEW,
    "mark_thresholds": """WITH s AS (SELECT CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, sqrt(4 * (1000 + 2 * w) * (1000 + 2 * h) // 4000 // h // w) AS t FROM range(5, 300, 11) AS a(w), range(5, 300, 13) AS b(h))
SELECT w, h, greatest(0.2e0, t - 1) AS local, greatest(0.2e0, t) AS distributed FROM s""",
    "rows_as_text": "SELECT CAST(id AS VARCHAR) AS id, coalesce(abbr, '') AS abbr, coalesce(city, '') AS city, coalesce(CAST(rank AS VARCHAR), '') AS rank FROM (SELECT DISTINCT id, abbr, city, rank FROM teams WHERE id IS NOT NULL)",
    "dump_roundtrip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "column_kinds": "SELECT name, type AS kind FROM pragma_table_info('lineitem')",
    "kept_documents": "SELECT n_name, n_regionkey AS region, 2 AS version FROM nation",
    "number_series": "SELECT n, n % 16 AS hash_key FROM range(1, 5001) AS t(n)",
    "ssv_hover": _DEEP + "SELECT level, head, round(min(c_acctbal), 4) AS minx, round(min(py), 4) AS miny, round(max(c_acctbal), 4) AS maxx, round(max(py), 4) AS maxy FROM m GROUP BY ALL",
}
