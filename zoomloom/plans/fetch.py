"""Queries of placement, viewport fetching, tiles, layouts and jumps, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.functions import scales
from zoomloom.operators import layouts, mutations, viewport
from zoomloom.operators.placement import BOX, Placement, place, project_layer, wire_rows
from zoomloom.operators.viewport import Box
from zoomloom.session import shared_dir, table
from zoomloom.spec import navigation
from zoomloom.spec.predicates import Both, Equals, parse_wire, to_column

NEW, OLD = Box(2000, 1000, 4000, 2500), Box(1000, 500, 3000, 2000)
KEYS = ["l_orderkey", "l_linenumber"]
MARKS = Placement("col:px", "col:py", "con:40", "con:20")


def items(spark: SparkSession, d: str) -> DataFrame:
    """lineitem on a canvas of 10 000 x 5 000: price to the right, quantity down."""
    t = table(spark, d, "lineitem").withColumns({"px": scales.linear(F.col("l_extendedprice"), (0, 100_000), (0, 10_000)), "py": scales.linear(F.col("l_quantity"), (0, 50), (0, 5_000))})
    return place(t, MARKS)


_written: dict[tuple, layouts.Written] = {}


def layer(spark: SparkSession, d: str, layout: str = "box", rows=None) -> layouts.Written:
    """lineitem as a written layer: built once a session from the whole table, then queried as a client would."""
    key = (spark.sparkContext.applicationId, d, layout)
    if key not in _written or not _written[key].exists():
        path = f"{shared_dir(spark)}/layer-{layout}-{uuid.uuid4().hex}"
        layouts.write((rows or items)(spark, d), path, Box(0, 0, 10_000, 5_000), layout)
        _written[key] = layouts.Written(spark, path)
    return _written[key]


def _keys(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def viewport_box(spark, d):
    return _keys(layer(spark, d).in_box(NEW))


def viewport_box_predicate(spark, d):
    p = parse_wire("((l_returnflag='R') AND (l_linestatus='F'))", ["l_returnflag", "l_linestatus"])
    return _keys(layer(spark, d).in_box(NEW).where(to_column(p)))


def dynamic_box(spark, d):
    return _keys(layer(spark, d).in_box(viewport.dynamic_box(2500, 1200, 1000, 800, 10_000, 5_000)))


def delta_exclude(spark, d):
    return _keys(layer(spark, d).added(NEW, OLD))


def delta_region(spark, d):
    return _keys(viewport.delta_region(layer(spark, d).stored, NEW, OLD))


def center_box(spark, d):
    return _keys(viewport.centers_in_box(layer(spark, d).stored, NEW, 40, 20, OLD))


def incremental_state(spark, d):
    rows = layer(spark, d)
    return viewport.incremental(_boxed(rows.added(NEW, OLD)), _boxed(rows.in_box(OLD)), NEW).select(*KEYS)


def _boxed(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, *BOX)


def tile_assign(spark, d):
    return viewport.assign_tiles(_boxed(items(spark, d))).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def tile_fetch(spark, d):
    return layer(spark, d, "tile").tile(2, 1).select(*KEYS)


def tile_join(spark, d):
    """The join layout: a side table of tiles, joined by the key of the rows (line numbers repeat within an order, so price and quantity belong to it)."""
    rows, key = items(spark, d), [*KEYS, "l_extendedprice", "l_quantity"]
    return viewport.fetch_by_index(rows, viewport.tile_index(rows, key), key, 2, 1).select(*KEYS)


def tile_box(spark, d):
    """A box over the tiled layer: each row once, though it lies in several tiles."""
    return _keys(layer(spark, d, "tile").in_box(NEW))


def tile_union_dedup(spark, d):
    tiles = viewport.viewport_tiles(1500, 900, 2000, 1000, 10_000, 5_000)
    return viewport.fetch_tiles(layer(spark, d, "tile").stored.select(*KEYS, *BOX, "tile_x", "tile_y"), tiles).select(*KEYS)


def grid_pack(spark, d):
    packed = viewport.pack_grid(_boxed(items(spark, d)), KEYS)
    return packed.groupBy("grid_x", "grid_y").agg(F.sum("n").alias("n"), *[F.round(f(c), 6).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])


def grid_unpack_region(spark, d):
    return layer(spark, d, "grid").in_box(NEW).select(*KEYS)


def _slab(spark: SparkSession, d: str) -> DataFrame:
    orders = place(table(spark, d, "orders").withColumns({"px": scales.linear(F.col("o_totalprice"), (0, 500_000), (0, 10_000)), "py": F.pmod("o_custkey", F.lit(5000)).cast("double")}), MARKS)
    return viewport.as_slab(orders.select(F.col("o_orderkey").alias("key"), *BOX), 0).unionByName(viewport.as_slab(items(spark, d).select(F.col("l_orderkey").alias("key"), *BOX), 1))


def cube_region(spark, d):
    return layer(spark, d, "slab", _slab).in_box(NEW, canvas=0).select("key", F.lit(0).alias("canvas_idx"))


def xpartition_region(spark, d):
    strips = layer(spark, d, "strip")
    return viewport.in_strips(strips.stored, NEW, strips.told["width"], strips.told["half"]).select(*KEYS, "strip")


def kd_leaf_counts(spark, d):
    """Rows of each leaf of given splits; a value on a split lies left of it."""
    return items(spark, d).groupBy(viewport.kd_leaf(F.col("cx"), [1500.0, 3000.0, 5000.0]).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


def layer_projection(spark, d):
    return project_layer(layer(spark, d).in_box(NEW), ["l_orderkey", "l_linenumber", "l_returnflag"]).select(*KEYS, "l_returnflag", *[F.round(c, 6).alias(c) for c in BOX])


def wire_dictionaries(spark, d):
    t = place(table(spark, d, "teams").select("id", "abbr", "rank").distinct(), None, static=True)
    return wire_rows(t.where("id is not null"), ["id", "abbr", "rank"]).select(F.get_json_object("row", "$.id").alias("id"), F.get_json_object("row", "$.abbr").alias("abbr"), F.get_json_object("row", "$.rank").alias("rank"))


def full_placement(spark, d):
    t = place(table(spark, d, "nation"), Placement("full", "con:1", "con:2", "con:3"))
    return viewport.in_box(t, NEW).select("n_nationkey", *BOX)


def grid_slots(spark, d):
    x, y = scales.grid_slot(F.col("id"), 6, 80.0, 100.0)
    return table(spark, d, "teams").where("id is not null").select("id", x.alias("x"), y.alias("y")).distinct()


def ratio_rescale(spark, d):
    return table(spark, d, "games").select("id", F.round(scales.rescale(F.col("home_score").cast("string"), 200, 1000), 6).alias("x"))


def timeline_lane(spark, d):
    t = table(spark, d, "orders")
    x = scales.time_position(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"), "1992-01-01", "1999-01-01", (82, 918))
    return t.select("o_orderkey", F.round(x, 6).alias("x"), scales.day_lane(F.col("o_orderdate").cast("date"), 100, 200).alias("lane"))


def reverse_transform(spark, d):
    x = scales.time_position(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"), "1992-01-01", "1999-01-01", (82, 918))
    return table(spark, d, "orders").select("o_orderkey", x.alias("x")).withColumns(mutations.reverse_time(F.col("x"), "1992-01-01", 2557, (82, 918))).drop("x")


def dot_tiles(spark, d):
    """The raw dots scaled to the large canvas, counted by tile."""
    t = table(spark, d, "dots_skewed_80_20").distinct().where("w between 0 and 100000 and h between 0 and 100000")
    t = t.withColumns({"px": scales.linear(F.col("w"), (0, 100_000), (0, 1_000_000)), "py": scales.linear(F.col("h"), (0, 100_000), (0, 1_000_000))})
    tiled = viewport.assign_tiles(place(t, Placement("col:px", "col:py", "con:1", "con:1")).select("id", *BOX), 65_536)
    return tiled.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def centroid_lookup(spark, d):
    t = place(table(spark, d, "nation").withColumns({"px": F.col("n_nationkey") * 10.0, "py": F.col("n_regionkey") * 7.0}), Placement("col:px", "col:py", "con:1", "con:1"))
    cx, cy = navigation.centroid(t, Equals("n_nationkey", "7"))
    return spark.createDataFrame([(cx, cy)], "cx double, cy double")


def jump_semijoin(spark, d):
    clicked = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return navigation.jump_rows_batch(table(spark, d, "orders"), clicked, ["o_custkey"]).select("o_orderkey", "o_custkey")


def jump_predicate(spark, d):
    return navigation.jump_rows(table(spark, d, "orders"), Both(Equals("o_orderstatus", "F"), Equals("o_orderpriority", "1-URGENT"))).select("o_orderkey")


def highlighted(spark, d):
    return navigation.highlight(table(spark, d, "orders"), Equals("o_orderstatus", "F")).select("o_orderkey", "highlighted", "opacity")


def update_rows(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = t.where("o_orderkey % 97 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return mutations.update_rows(t, changes, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


QUERIES = {f.__name__: f for f in (viewport_box, viewport_box_predicate, dynamic_box, delta_exclude, delta_region, center_box, incremental_state, tile_assign, tile_fetch, tile_join, tile_box, tile_union_dedup, grid_pack, grid_unpack_region, cube_region, xpartition_region, kd_leaf_counts, layer_projection, wire_dictionaries, full_placement, grid_slots, ratio_rescale, timeline_lane, reverse_transform, dot_tiles, centroid_lookup, jump_semijoin, jump_predicate, highlighted, update_rows)}

_ITEMS = """WITH c AS (SELECT *, (l_extendedprice - 0e0) / 100000e0 * 10000e0 + 0e0 AS cx, (l_quantity - 0e0) / 50e0 * 5000e0 + 0e0 AS cy FROM lineitem),
b AS (SELECT *, cx - 20 AS minx, cy - 10 AS miny, cx + 20 AS maxx, cy + 10 AS maxy FROM c)
"""
_IN_NEW = "maxx >= 2000 AND minx <= 4000 AND maxy >= 1000 AND miny <= 2500"
_IN_OLD = "maxx >= 1000 AND minx <= 3000 AND maxy >= 500 AND miny <= 2000"
_SHOW = "SELECT l_orderkey, l_linenumber, round(cx, 6) AS cx, round(cy, 6) AS cy FROM b WHERE "
_ID = "SELECT l_orderkey, l_linenumber FROM b WHERE "
_DAY = "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"

ORACLE = {
    "viewport_box": _ITEMS + _SHOW + _IN_NEW,
    "viewport_box_predicate": _ITEMS + _SHOW + _IN_NEW + " AND l_returnflag = 'R' AND l_linestatus = 'F'",
    "dynamic_box": _ITEMS + _SHOW + "maxx >= 2000 AND minx <= 4000 AND maxy >= 800 AND miny <= 2400",
    "delta_exclude": _ITEMS + _SHOW + f"{_IN_NEW} AND NOT ({_IN_OLD})",
    "delta_region": _ITEMS + _SHOW + "((maxx >= 3000 AND minx <= 4000 AND maxy >= 1000 AND miny <= 2500) OR (maxx >= 2000 AND minx <= 3000 AND maxy >= 2000 AND miny <= 2500))",
    "center_box": _ITEMS + _SHOW + "cx BETWEEN 1980 AND 4020 AND cy BETWEEN 990 AND 2510 AND NOT (cx BETWEEN 1020 AND 2980 AND cy BETWEEN 510 AND 1990)",
    "incremental_state": _ITEMS + _ID + _IN_NEW,
    "tile_assign": _ITEMS + """, x AS (SELECT *, unnest(range(greatest(0, CAST(floor(minx / 1024) AS BIGINT)), CAST(floor(maxx / 1024) AS BIGINT) + 1)) AS tile_x FROM b),
y AS (SELECT tile_x, unnest(range(greatest(0, CAST(floor(miny / 1024) AS BIGINT)), CAST(floor(maxy / 1024) AS BIGINT) + 1)) AS tile_y FROM x)
SELECT tile_x, tile_y, count(*) AS n FROM y GROUP BY ALL""",
    "tile_fetch": _ITEMS + _ID + "floor(minx / 1024) <= 2 AND floor(maxx / 1024) >= 2 AND floor(miny / 1024) <= 1 AND floor(maxy / 1024) >= 1",
    "tile_join": _ITEMS + _ID + "floor(minx / 1024) <= 2 AND floor(maxx / 1024) >= 2 AND floor(miny / 1024) <= 1 AND floor(maxy / 1024) >= 1",
    "tile_box": _ITEMS + _SHOW + _IN_NEW,
    "tile_union_dedup": _ITEMS + _ID + "floor(minx / 1024) <= 3 AND floor(maxx / 1024) >= 1 AND floor(miny / 1024) <= 1 AND floor(maxy / 1024) >= 0",
    "grid_pack": _ITEMS + "SELECT CAST(trunc(trunc(cx) / 1000) AS BIGINT) AS grid_x, CAST(trunc(trunc(cy) / 1000) AS BIGINT) AS grid_y, count(*) AS n, round(min(minx), 6) AS minx, round(min(miny), 6) AS miny, round(max(maxx), 6) AS maxx, round(max(maxy), 6) AS maxy FROM b GROUP BY ALL",
    "grid_unpack_region": _ITEMS + _ID + _IN_NEW,
    "cube_region": """WITH c AS (SELECT o_orderkey AS key, (o_totalprice - 0e0) / 500000e0 * 10000e0 + 0e0 AS cx, CAST(o_custkey % 5000 AS DOUBLE) AS cy FROM orders)
SELECT key, 0 AS canvas_idx FROM c WHERE cx + 20 >= 2000 AND cx - 20 <= 4000 AND cy + 10 >= 1000 AND cy - 10 <= 2500""",
    "xpartition_region": _ITEMS + f"SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(49, floor(cx / 200))) AS INTEGER) AS strip FROM b WHERE {_IN_NEW}",
    "kd_leaf_counts": _ITEMS + "SELECT CASE WHEN cx <= 1500 THEN 0 WHEN cx <= 3000 THEN 1 WHEN cx <= 5000 THEN 2 ELSE 3 END AS leaf, count(*) AS n FROM b GROUP BY ALL",
    "layer_projection": _ITEMS + f"SELECT l_orderkey, l_linenumber, l_returnflag, round(cx, 6) AS cx, round(cy, 6) AS cy, round(minx, 6) AS minx, round(miny, 6) AS miny, round(maxx, 6) AS maxx, round(maxy, 6) AS maxy FROM b WHERE {_IN_NEW}",
    "wire_dictionaries": "SELECT CAST(id AS VARCHAR) AS id, coalesce(abbr, '') AS abbr, coalesce(CAST(rank AS VARCHAR), '') AS rank FROM (SELECT DISTINCT id, abbr, rank FROM teams WHERE id IS NOT NULL)",
    "full_placement": f"SELECT n_nationkey, 0e0 AS cx, 0e0 AS cy, {-2147483647 / 2}::DOUBLE AS minx, {-2147483647 / 2}::DOUBLE AS miny, {2147483647 / 2}::DOUBLE AS maxx, {2147483647 / 2}::DOUBLE AS maxy FROM nation",
    "grid_slots": "SELECT DISTINCT id, (2 * (id - 6 * (id // 6)) + 1) * 80e0 AS x, (2 * (id // 6) + 1) * 80e0 + 100e0 AS y FROM teams WHERE id IS NOT NULL",
    "ratio_rescale": "SELECT id, round(home_score / 200e0 * 1000e0, 6) AS x FROM games",
    "timeline_lane": f"SELECT o_orderkey, round({_DAY}::DOUBLE / 2557 * 836e0 + 82e0, 6) AS x, CASE WHEN date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) % 2 = 0 THEN 100e0 ELSE 200e0 END AS lane FROM orders",
    "reverse_transform": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders",
    "dot_tiles": """WITH t AS (SELECT DISTINCT * FROM dots_skewed_80_20 WHERE w BETWEEN 0 AND 100000 AND h BETWEEN 0 AND 100000),
b AS (SELECT w / 100000e0 * 1000000e0 AS cx, h / 100000e0 * 1000000e0 AS cy FROM t),
x AS (SELECT cy, unnest(range(greatest(0, CAST(floor((cx - 0.5) / 65536) AS BIGINT)), CAST(floor((cx + 0.5) / 65536) AS BIGINT) + 1)) AS tile_x FROM b),
y AS (SELECT tile_x, unnest(range(greatest(0, CAST(floor((cy - 0.5) / 65536) AS BIGINT)), CAST(floor((cy + 0.5) / 65536) AS BIGINT) + 1)) AS tile_y FROM x)
SELECT tile_x, tile_y, count(*) AS n FROM y GROUP BY ALL""",
    "centroid_lookup": "SELECT n_nationkey * 10e0 AS cx, n_regionkey * 7e0 AS cy FROM nation WHERE n_nationkey = 7",
    "jump_semijoin": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "jump_predicate": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "highlighted": "SELECT o_orderkey, o_orderstatus = 'F' AS highlighted, CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0.4e0 END AS opacity FROM orders",
    "update_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders",
}
