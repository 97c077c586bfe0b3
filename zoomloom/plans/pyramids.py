"""Queries of cluster pyramids, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.operators import pyramid
from zoomloom.operators.pyramid import PyramidSpec, build_pyramid
from zoomloom.operators.viewport import kd_leaf, kd_splits
from zoomloom.session import table

LEAF_ROWS = 100_000
ONE = PyramidSpec("c_custkey", "c_acctbal", "py", "pz", (-1000, 10_000), (0, 10_007), levels=1, mark_w=40, mark_h=40, theta=1.0, measures=("c_acctbal",), dimensions=("c_mktsegment",))
DEEP = PyramidSpec("c_custkey", "c_acctbal", "py", "pz", (-1000, 10_000), (0, 10_007), levels=3, mark_w=60, mark_h=60, theta=1.0, measures=("c_acctbal",))


def points(spark: SparkSession, d: str) -> DataFrame:
    """customer with a second coordinate and an importance that follow neither the first nor each other."""
    return table(spark, d, "customer").withColumns({"py": F.pmod(F.col("c_custkey") * 7919, F.lit(10_007)).cast("double"), "pz": F.pmod(F.col("c_custkey") * 31337, F.lit(65_537))})


def ssv_coords(spark, d):
    return pyramid.init_points(points(spark, d), ONE).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def ssv_extent(spark, d):
    return pyramid.extents(table(spark, d, "customer"), "c_acctbal", "c_custkey")


def ssv_level_heads(spark, d):
    return build_pyramid(points(spark, d), ONE).levels.where("level = 1").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def ssv_cluster_aggs(spark, d):
    a = build_pyramid(points(spark, d), ONE).aggregates.where("level = 1")
    return a.select("head", "c_mktsegment", "n", *[F.round(f"{f}_c_acctbal", 4).alias(f) for f in ("sum", "min", "max", "sqrsum")])


def ssv_topk(spark, d):
    return build_pyramid(points(spark, d), ONE).top.where("level = 1").select("head", "place", "id")


def ssv_conservation(spark, d):
    return build_pyramid(points(spark, d), DEEP).aggregates.groupBy("level").agg(F.sum("n").alias("n"))


def ssv_bgrp(spark, d):
    """Value ranges of every level."""
    told = pyramid.measure_ranges(build_pyramid(points(spark, d), DEEP).aggregates, ["c_acctbal"])
    return told.select("level", "rough_n", "min_n", "max_n", *[F.round(c, 4).alias(c) for c in ("min_sum_c_acctbal", "max_sum_c_acctbal")])


def ssv_hull(spark, d):
    """Corners of the hull of every cluster on every level."""
    return build_pyramid(points(spark, d), DEEP).hulls.select("level", "head", F.explode("hull").alias("p")).select("level", "head", "p.x", "p.y")


def ssv_wire(spark, d):
    """The aggregates as a client gets them: one key a measure and function."""
    keys = pyramid.cluster_keys(build_pyramid(points(spark, d), DEEP).aggregates, [], ["c_acctbal"], ["sum", "avg"])
    return keys.select("level", "head", F.explode("cluster_agg").alias("key", "v")).select("level", "head", "key", F.round(F.col("v") + 1e-9, 4).alias("v"))


def ssv_moments(spark, d):
    """Sums of positions and of their squares on every level, merged from the level below."""
    return build_pyramid(points(spark, d), DEEP).aggregates.select("level", "head", "n", *[F.round(c, 4).alias(c) for c in ("sum_x", "sum_y", "xysqrsum")])


def ssv_dots(spark, d):
    """The pyramid of all raw dots on the plane, as a map of marks; the crowded corner has a thousand times the dots of the rest."""
    dots = table(spark, d, "dots_skewed_80_20").where("id is not null and w between 0 and 100000 and h between 0 and 100000").select("id", "w", "h").distinct()
    spec = PyramidSpec("id", "w", "h", "pz", (0, 100_000), (0, 100_000), levels=2, mark_w=16, mark_h=16, theta=1.0, measures=("w",), mode="circle")
    made = build_pyramid(dots.withColumn("pz", F.pmod(F.col("id").cast("long") * 31337, F.lit(65_537))), spec)
    return made.aggregates.groupBy("level").agg(F.count(F.lit(1)).alias("heads"), F.sum("n").alias("dots"), F.sum("sum_w").cast("long").alias("w"))


def ssv_border_merge(spark, d):
    """The distributed approximation: heads by KD leaf of about LEAF_ROWS points, then one sweep along the splits."""
    p = pyramid.init_points(points(spark, d), ONE)
    splits = kd_splits(p, max(4, math.ceil(p.count() / LEAF_ROWS)), "x")

    def per_leaf(pdf):
        return pdf[pyramid.greedy_sequence(pdf["z"].to_numpy(), pdf["id"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy(), 40.0, 40.0)]

    leaf = p.withColumn("leaf", kd_leaf(F.col("x"), splits))
    heads = leaf.groupBy("leaf").applyInPandas(per_leaf, leaf.schema).drop("leaf")
    return pyramid.merge_along_splits(heads, splits, 40.0, 40.0).select("id")


QUERIES = {f.__name__: f for f in (ssv_coords, ssv_extent, ssv_level_heads, ssv_cluster_aggs, ssv_topk, ssv_conservation, ssv_bgrp, ssv_hull, ssv_wire, ssv_moments, ssv_dots, ssv_border_merge)}

_POINTS = """pts AS (SELECT c_custkey AS id, c_mktsegment, c_acctbal, CAST(c_custkey * 7919 % 10007 AS DOUBLE) AS py, c_custkey * 31337 % 65537 AS pz FROM customer WHERE c_acctbal IS NOT NULL),
pos AS (SELECT id, c_mktsegment, c_acctbal, pz, row_number() OVER (ORDER BY pz DESC, id) AS r, (960e0 * (c_acctbal - -1000e0) / 11000e0 + 20e0) * 2e0 AS x, (960e0 * (py - 0e0) / 10007e0 + 20e0) * 2e0 AS y FROM pts)"""
_HEADS = f"""WITH RECURSIVE {_POINTS},
g(r, heads) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, r BIGINT, x DOUBLE, y DOUBLE)[])
  UNION ALL SELECT p.r, CASE WHEN len(list_filter(g.heads, lambda h: abs(h.x - p.x) <= 40 AND abs(h.y - p.y) <= 40)) > 0 THEN g.heads
    ELSE list_append(g.heads, {{'id': CAST(p.id AS BIGINT), 'r': p.r, 'x': p.x, 'y': p.y}}) END FROM g JOIN pos p ON p.r = g.r + 1),
h AS (SELECT unnest(heads, max_depth := 2) FROM g WHERE r = (SELECT max(r) FROM pos))"""
_MEMBERS = _HEADS + """, m AS (SELECT p.*, arg_min(h.id, {'d': greatest(abs(h.x - p.x), abs(h.y - p.y)) / 40e0, 'r': h.r}) OVER (PARTITION BY p.id) AS head
  FROM pos p JOIN h ON h.r <= p.r AND abs(h.x - p.x) <= 40 AND abs(h.y - p.y) <= 40),
mm AS (SELECT DISTINCT * FROM m)"""



def levels_sql() -> str:
    """All levels of DEEP: hN the heads of level N with rank and position there, kN (id, head) of every base row."""
    source = "pos"
    parts = [_POINTS.replace("960e0", "940e0").replace("20e0) * 2e0", "30e0) * 8e0")]
    for level in range(DEEP.levels, -1, -1):
        scale = "" if source == "pos" else " / 2e0"
        near = "abs(h.x - p.x) <= 60 AND abs(h.y - p.y) <= 60"
        own = f"p{level} AS (SELECT id, row_number() OVER (ORDER BY r) AS r, x{scale} AS x, y{scale} AS y FROM {source})"
        walk = f"""g{level}(r, heads) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, r BIGINT, x DOUBLE, y DOUBLE)[])
  UNION ALL SELECT p.r, CASE WHEN len(list_filter(g.heads, lambda h: {near})) > 0 THEN g.heads ELSE list_append(g.heads, {{'id': CAST(p.id AS BIGINT), 'r': p.r, 'x': p.x, 'y': p.y}}) END FROM g{level} g JOIN p{level} p ON p.r = g.r + 1)"""
        heads = f"h{level} AS (SELECT unnest(heads, max_depth := 2) FROM g{level} WHERE r = (SELECT max(r) FROM p{level}))"
        step = f"s{level} AS (SELECT p.id, arg_min(h.id, {{'d': greatest(abs(h.x - p.x), abs(h.y - p.y)) / 60e0, 'r': h.r}}) AS head FROM p{level} p JOIN h{level} h ON h.r <= p.r AND {near} GROUP BY p.id)"
        chain = f"k{level} AS (SELECT id, head FROM s{level})" if source == "pos" else f"k{level} AS (SELECT k.id, s.head FROM k{level + 1} k JOIN s{level} s ON s.id = k.head)"
        parts += [own, walk, heads, step, chain]
        source = f"h{level}"
    every = " UNION ALL ".join(f"SELECT CAST({level} AS INTEGER) AS level, k.head, p.id, p.c_acctbal, p.py FROM k{level} k JOIN pts p ON p.id = k.id" for level in range(DEEP.levels + 1))
    return "WITH RECURSIVE " + ",\n".join(parts) + f",\nm AS ({every})\n"


ORACLE = {
    "ssv_coords": f"WITH {_POINTS} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM pos",
    "ssv_extent": "SELECT min(c_acctbal) AS lo_x, max(c_acctbal) AS hi_x, min(c_custkey) AS lo_y, max(c_custkey) AS hi_y FROM customer",
    "ssv_level_heads": _HEADS + " SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM h",
    "ssv_cluster_aggs": _MEMBERS + " SELECT head, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 4) AS sum, round(min(c_acctbal), 4) AS min, round(max(c_acctbal), 4) AS max, round(sum(c_acctbal * c_acctbal), 4) AS sqrsum FROM mm GROUP BY ALL",
    "ssv_topk": _MEMBERS + " SELECT head, CAST(row_number() OVER (PARTITION BY head ORDER BY pz DESC, id) AS INTEGER) AS place, id FROM mm QUALIFY place <= 3",
    "ssv_bgrp": levels_sql() + """, c AS (SELECT level, head, count(*) AS n, sum(c_acctbal) AS s FROM m GROUP BY ALL)
SELECT level, count(*) AS rough_n, min(n) AS min_n, max(n) AS max_n, round(min(s), 4) AS min_sum_c_acctbal, round(max(s), 4) AS max_sum_c_acctbal FROM c GROUP BY ALL""",
    "ssv_hull": levels_sql() + """, d AS (SELECT DISTINCT level, head, c_acctbal AS x, py AS y FROM m), size AS (SELECT level, head, count(*) AS n FROM d GROUP BY ALL),
a AS (SELECT p.level, p.head, p.x, p.y, atan2(q.y - p.y, q.x - p.x) AS w FROM d p JOIN d q ON p.level = q.level AND p.head = q.head AND (p.x <> q.x OR p.y <> q.y)),
gap AS (SELECT level, head, x, y, coalesce(lead(w) OVER o, first_value(w) OVER o + 2 * pi()) - w AS g FROM a WINDOW o AS (PARTITION BY level, head, x, y ORDER BY w))
SELECT level, head, x, y FROM gap GROUP BY ALL HAVING max(g) > pi() + 1e-9
UNION ALL SELECT level, head, x, y FROM d JOIN size USING (level, head) WHERE n = 1""",
    "ssv_wire": levels_sql() + """, c AS (SELECT level, head, count(*)::DOUBLE AS n, sum(c_acctbal) AS s, avg(c_acctbal) AS a FROM m GROUP BY ALL)
SELECT level, head, 'count(*)' AS key, n AS v FROM c UNION ALL SELECT level, head, 'sum(c_acctbal)', round(s + 1e-9, 4) FROM c UNION ALL SELECT level, head, 'avg(c_acctbal)', round(a + 1e-9, 4) FROM c""",
    "ssv_moments": levels_sql() + "SELECT level, head, count(*) AS n, round(sum(c_acctbal), 4) AS sum_x, round(sum(py), 4) AS sum_y, round(sum(c_acctbal * c_acctbal + py * py), 4) AS xysqrsum FROM m GROUP BY ALL",
    "ssv_conservation": "SELECT CAST(l AS INTEGER) AS level, n FROM range(4) AS t(l), (SELECT count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL)",
}
