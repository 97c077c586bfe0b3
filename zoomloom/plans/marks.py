"""Queries of marks, scales, layouts and viewport arithmetic, with their SQL. Tables of 300 viewports and 25 nations have one size whatever the scale."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from zoomloom.functions import scales
from zoomloom.operators import charts, pyramid, viewport
from zoomloom.operators.viewport import Box
from zoomloom.plans.shows import static_agg_treemap
from zoomloom.session import table
from zoomloom.spec import navigation

BOX = ("minx", "miny", "maxx", "maxy")
PALETTE = ["red", "green", "blue"]


def _viewports(spark: SparkSession, d: str) -> list[tuple]:
    """(id, box) of the saved viewports that are whole, with the corners put right; about 300 at any size."""
    rows = table(spark, d, "viewports").select("viewport_id", *BOX).distinct().where(" and ".join(f"{c} is not null and not isnan({c})" for c in BOX)).collect()
    return [(r[0], Box(min(r[1], r[3]), min(r[2], r[4]), max(r[1], r[3]), max(r[2], r[4]))) for r in rows]


def mark_scales(spark, d):
    """Radius by a square-root scale, position by a clamped one, and the band of a brand."""
    t = table(spark, d, "part")
    start, width = scales.band(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 10, 10, (0, 500))
    return t.select("p_partkey", F.round(scales.sqrt_scale(F.col("p_size"), (0, 50), (2, 40)), 6).alias("radius"), F.round(scales.clamped(F.col("p_retailprice"), (1000, 1500), (0, 100)), 6).alias("x"), F.round(start, 6).alias("start"), F.lit(round(width, 6)).alias("width"))


def mark_sizes(spark, d):
    """Width of the marks of every mode by its greatest size."""
    rows = [(m, s, pyramid.mark_size(m, s)[0]) for m in ("circle", "contour", "heatmap", "radar", "pie", "dot") for s in range(1, 60)]
    return spark.createDataFrame(rows, "mode string, size int, width int")


def mark_colors(spark, d):
    """A colour for each brand, around the palette in the order of the brands."""
    return charts.ordinal_colors(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", PALETTE)


def pie_by_palette(spark, d):
    """A pie has no more slices than its palette has colours."""
    return charts.chart(table(spark, d, "part"), "pie", ["p_brand"], "COUNT(*)", palette=PALETTE)


def treemap_areas(spark, d):
    """Rectangles of a treemap: their areas, and that they lie in the canvas without overlapping."""
    rows = [(r["l_returnflag"], r["l_linestatus"], r["agg_value"]) for r in static_agg_treemap(spark, d).collect()]  # 80 at most
    rows.sort(key=lambda r: -r[2])
    boxes = charts.treemap([r[2] for r in rows], 1000.0, 600.0)
    apart = lambda a, b: a[0] + a[2] <= b[0] + 1e-6 or b[0] + b[2] <= a[0] + 1e-6 or a[1] + a[3] <= b[1] + 1e-6 or b[1] + b[3] <= a[1] + 1e-6
    inside = all(x >= -1e-6 and y >= -1e-6 and x + w <= 1000 + 1e-6 and y + h <= 600 + 1e-6 for x, y, w, h in boxes)
    whole = inside and all(apart(a, b) for i, a in enumerate(boxes) for b in boxes[:i])
    return spark.createDataFrame([(f, s, round(w * h, 2), whole) for (f, s, _), (_, _, w, h) in zip(rows, boxes)], "l_returnflag string, l_linestatus string, area double, whole boolean")


def axis_domains(spark, d):
    """Data ranges of the part of an axis that each saved viewport shows, on a canvas of 1 000 000."""
    rows = [(i, *(round(v, 6) for v in navigation.axis_range((-50.0, 150.0), 1_000_000.0, b.minx, b.maxx))) for i, b in _viewports(spark, d)]
    return spark.createDataFrame(rows, "viewport_id int, lo double, hi double")


def refetches(spark, d):
    """Which moves of saved viewports, by a quarter of their size to the right, ask for a new box."""
    rows = []
    for i, b in _viewports(spark, d):
        held = viewport.dynamic_box(b.minx, b.miny, b.width, b.height, 1_000_000, 1_000_000)
        rows.append((i, *(round(v, 6) for v in (held.minx, held.miny, held.maxx, held.maxy)), viewport.needs_fetch(b.minx + b.width / 4, b.miny, b.width, b.height, held, 1_000_000, 1_000_000)))
    return spark.createDataFrame(rows, "viewport_id int, x0 double, y0 double, x1 double, y1 double, again boolean")


def box_text(spark, d):
    """Boxes as text for a client."""
    return spark.createDataFrame([(i, b.csv(), b.wkt()) for i, b in _viewports(spark, d)], "viewport_id int, csv string, wkt string")


def slides(spark, d):
    """Corners after sliding each saved viewport by its size, in 8 directions."""
    rows = [(i, a, *(round(v, 4) for v in navigation.slide((b.minx, b.miny), (b.width, b.height), a))) for i, b in _viewports(spark, d) for a in range(0, 360, 45)]
    return spark.createDataFrame(rows, "viewport_id int, direction int, x double, y double")


QUERIES = {f.__name__: f for f in (mark_scales, mark_sizes, mark_colors, pie_by_palette, treemap_areas, axis_domains, refetches, box_text, slides)}

_VIEWS = """WITH v AS (SELECT DISTINCT viewport_id, least(minx, maxx) AS x, least(miny, maxy) AS y, greatest(minx, maxx) AS u, greatest(miny, maxy) AS w FROM viewports
WHERE minx IS NOT NULL AND miny IS NOT NULL AND maxx IS NOT NULL AND maxy IS NOT NULL AND NOT isnan(minx) AND NOT isnan(miny) AND NOT isnan(maxx) AND NOT isnan(maxy))
"""
_STEP = 500 / 10.1

ORACLE = {
    "mark_scales": f"""SELECT p_partkey, round(sqrt(p_size) / sqrt(50) * 38 + 2, 6) AS radius, round((greatest(1000, least(1500, p_retailprice)) - 1000) / 500 * 100, 6) AS x,
  round(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 10 * {_STEP!r}::DOUBLE + {0.1 * _STEP!r}::DOUBLE, 6) AS start, {round(_STEP * 0.9, 6)!r}::DOUBLE AS width FROM part""",
    "mark_sizes": """SELECT mode, CAST(s AS INTEGER) AS size, CAST(CASE mode WHEN 'circle' THEN 2 * s WHEN 'contour' THEN 2 * s WHEN 'heatmap' THEN 2 * s + 1 WHEN 'dot' THEN floor(2.5 * s) ELSE 290 END AS INTEGER) AS width
FROM unnest(['circle', 'contour', 'heatmap', 'radar', 'pie', 'dot']) AS a(mode), range(1, 60) AS b(s)""",
    "mark_colors": "SELECT p_partkey, p_brand, (['red', 'green', 'blue'])[CAST((dense_rank() OVER (ORDER BY p_brand) - 1) % 3 + 1 AS INTEGER)] AS color FROM part",
    "pie_by_palette": "SELECT p_brand, count(*) AS agg_value FROM part GROUP BY ALL ORDER BY agg_value DESC, p_brand LIMIT 3",
    "treemap_areas": "WITH t AS (SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(q / sum(q) OVER () * 600000, 2) AS area, TRUE AS whole FROM t",
    "axis_domains": _VIEWS + "SELECT viewport_id, round(-50 + greatest(0, x) / 1000000e0 * 200, 6) AS lo, round(-50 + least(1000000, u) / 1000000e0 * 200, 6) AS hi FROM v",
    "refetches": _VIEWS + """, b AS (SELECT *, u - x AS dx, w - y AS dy, greatest(-10, x - (u - x) / 2) AS x0, greatest(-10, y - (w - y) / 2) AS y0 FROM v),
c AS (SELECT *, least(1000010, x0 + 2 * dx) AS x1, least(1000010, y0 + 2 * dy) AS y1, x + dx / 4 AS mx FROM b)
SELECT viewport_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, (mx - x0 < dx / 3 AND x0 > 0) OR (y - y0 < dy / 3 AND y0 > 0) OR (x1 - (mx + dx) < dx / 3 AND x1 < 1000000) OR (y1 - (y + dy) < dy / 3 AND y1 < 1000000) AS again FROM c""",
    "box_text": _VIEWS + "SELECT viewport_id, concat_ws(',', x, y, u, w) AS csv, 'POLYGON((' || x || ' ' || y || ',' || u || ' ' || y || ',' || u || ' ' || w || ',' || x || ' ' || w || ',' || x || ' ' || y || '))' AS wkt FROM v",
    "slides": _VIEWS + f"SELECT viewport_id, CAST(a AS INTEGER) AS direction, round(x + (u - x) * cos(a * {math.pi / 180!r}::DOUBLE), 4) AS x, round(y - (w - y) * sin(a * {math.pi / 180!r}::DOUBLE), 4) AS y FROM v, range(0, 360, 45) AS t(a)",
}
