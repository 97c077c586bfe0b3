"""Queries of the general data problems p1 and p3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.operators.skew_pairs import near_pairs_by_key
from zoomloom.operators.spatial_join import clean_boxes, near_and_inside
from zoomloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Nearly coinciding dots of one distribution id."""
    return near_pairs_by_key(table(spark, d, "dots_skewed_80_20"), "citus_distribution_id", "id", "w", "h", 2, 2, (0, 0, 100_000, 100_000))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Dots near other dots, and dots inside saved viewports."""
    dots = clean_boxes(table(spark, d, "bbox_dots_pushdown_uniform_toplayer0"), "id")
    dots = dots.where(~((F.col("x0") + F.col("x1") == 0) & (F.col("y0") + F.col("y1") == 0)))
    return near_and_inside(dots, clean_boxes(table(spark, d, "viewports"), "viewport_id"), 2.0)


QUERIES = {"p1_found": p1_found, "p3_found": p3_found}

_BOX = """SELECT DISTINCT {i} AS i, least(minx, maxx) AS x0, least(miny, maxy) AS y0, greatest(minx, maxx) AS x1, greatest(miny, maxy) AS y1 FROM {t}
WHERE minx IS NOT NULL AND miny IS NOT NULL AND maxx IS NOT NULL AND maxy IS NOT NULL AND NOT isnan(minx) AND NOT isnan(miny) AND NOT isnan(maxx) AND NOT isnan(maxy)"""

ORACLE = {
    "p1_found": """WITH d AS (SELECT DISTINCT citus_distribution_id AS k, id, w, h FROM dots_skewed_80_20
  WHERE citus_distribution_id IS NOT NULL AND w BETWEEN 0 AND 100000 AND h BETWEEN 0 AND 100000),
n AS (SELECT k, id, w, h, w // 3 + o AS c FROM d, (VALUES (-1), (0), (1)) AS t(o))
SELECT DISTINCT a.k AS citus_distribution_id, a.id AS id_a, b.id AS id_b
FROM d a JOIN n b ON a.k = b.k AND a.w // 3 = b.c
WHERE a.id < b.id AND abs(a.w - b.w) <= 2 AND abs(a.h - b.h) <= 2""",
    "p3_found": f"""WITH b AS (SELECT * FROM ({_BOX.format(i='id', t='bbox_dots_pushdown_uniform_toplayer0')}) WHERE NOT (x0 + x1 = 0 AND y0 + y1 = 0)),
v AS ({_BOX.format(i='viewport_id', t='viewports')}),
c AS (SELECT *, u AS cx FROM b, unnest(range(CAST(floor((x0 - 2) / 64) AS BIGINT), CAST(floor((x1 + 2) / 64) AS BIGINT) + 1)) AS t(u))
SELECT 'near' AS kind, p.i AS key_a, q.i AS key_b FROM c p JOIN c q ON p.cx = q.cx AND p.i < q.i AND q.y0 <= p.y1 + 2 AND q.y1 >= p.y0 - 2
WHERE power(greatest(0, p.x0 - q.x1, q.x0 - p.x1), 2) + power(greatest(0, p.y0 - q.y1, q.y0 - p.y1), 2) <= 4
GROUP BY ALL
UNION ALL
SELECT DISTINCT 'inside', CAST(v.i AS BIGINT), b.i FROM v JOIN b ON b.x0 >= v.x0 AND b.x1 <= v.x1 AND b.y0 >= v.y0 AND b.y1 <= v.y1""",
}
