"""Queries of charts, tables, joins, maps, density and the log, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.functions import geo, scales
from zoomloom.operators import charts, density, tables
from zoomloom.session import shared_dir, table
from zoomloom.sources import readers, sinks
from zoomloom.streaming import fetch_log


def _views(spark: SparkSession, d: str, *names: str) -> None:
    for n in names:
        readers.register(spark, n, f"{d}/{n}.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 4) for n in names})


def static_agg_pie(spark, d):
    return charts.chart(table(spark, d, "orders"), "pie", ["o_orderpriority"], "COUNT(*)")


def static_agg_bar(spark, d):
    return _rounded(charts.chart(table(spark, d, "part"), "bar", ["p_brand"], "MAX(p_retailprice)"), "agg_value")


def static_agg_treemap(spark, d):
    return _rounded(charts.chart(table(spark, d, "lineitem"), "treemap", ["l_returnflag", "l_linestatus"], "SUM(l_quantity)"), "agg_value")


def static_agg_pack(spark, d):
    return charts.chart(table(spark, d, "part"), "circlePack", ["p_type"], "COUNT(p_partkey)")


def static_agg_cloud(spark, d):
    return charts.cloud_sizes(charts.chart(table(spark, d, "part"), "wordCloud", ["p_brand"], "MIN(p_size)"), "agg_value")


def static_agg_stacked(spark, d):
    return charts.chart(table(spark, d, "orders"), "bar", ["o_orderpriority"], "COUNT(*)", stack=["o_orderstatus"])


def static_agg_filtered(spark, d):
    return _rounded(charts.chart(table(spark, d, "lineitem"), "bar", ["l_linestatus"], "AVG(l_quantity)", where=F.col("l_returnflag") == "R"), "agg_value")


def static_sample(spark, d):
    return _rounded(charts.sample_layer(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], ["o_orderkey"], F.col("o_orderstatus") == "F"), "o_totalprice")


def pie_angles(spark, d):
    return charts.pie_angles(charts.chart(table(spark, d, "orders"), "pie", ["o_orderpriority"], "COUNT(*)"), "agg_value", ["o_orderpriority"]).select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("share", "start_angle", "end_angle")])


def stacked_bar_layout(spark, d):
    return charts.stacked_bars(static_agg_stacked(spark, d), "agg_value", ["o_orderpriority"], "o_orderstatus")


def filled_domain(spark, d):
    t = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return charts.fill_domain(t, {"o_orderstatus": ["F", "O", "P", "Q"], "o_orderpriority": ["1-URGENT", "9-NONE"]}, {"n": "count"})


def radar_layout(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("c"), F.avg("l_tax").alias("t"))
    return charts.radar_points(t, ["l_returnflag"], {"q": (0, 50), "c": (0, 0.1), "t": (0, 0.1)}, 100).select("l_returnflag", "measure", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


def table_rownum(spark, d):
    return tables.number_rows(table(spark, d, "orders"), ["o_orderkey"], "o_totalprice desc, o_orderkey")


def table_rownum_grouped(spark, d):
    t = tables.number_rows(table(spark, d, "lineitem"), ["l_linenumber"], "l_linenumber, l_partkey, l_suppkey, l_extendedprice", ["l_orderkey"])
    return tables.cell_position(t, 40, 50, 0).select("l_orderkey", "l_linenumber", "rn", "cell_y")


def table_canvas_height(spark, d):
    return tables.canvas_height(table(spark, d, "orders"), 40, 50, F.col("o_orderstatus") == "F")


def join_two_table(spark, d):
    _views(spark, d, "orders", "customer")
    return readers.query(spark, "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_acctbal < 0")


def join_self_dim(spark, d):
    _views(spark, d, "nation", "region")
    return readers.query(spark, "SELECT a.n_name AS one, b.n_name AS two, r.r_name FROM nation a, nation b, region r WHERE a.n_regionkey = r.r_regionkey AND b.n_regionkey = r.r_regionkey AND a.n_nationkey < b.n_nationkey")


def cross_pairs(spark, d):
    r = table(spark, d, "region").select("r_name")
    return r.select(F.col("r_name").alias("one")).crossJoin(r.select(F.col("r_name").alias("two")))


def games_with_teams(spark, d):
    """Games joined twice to the team dimension; codes are put in plain form, repeated teams count once."""
    code = lambda c: F.upper(F.trim(F.col(c)))
    teams = table(spark, d, "teams").select("abbr", "city").distinct()
    g = table(spark, d, "games").select("id", code("home_team").alias("home"), code("away_team").alias("away"))
    return g.join(teams.toDF("home", "home_city"), "home").join(teams.toDF("away", "away_city"), "away").select("id", "home", "home_city", "away", "away_city")


def team_grid(spark, d):
    """A grouped table of games: the numbered home games of each team."""
    g = table(spark, d, "games").where("home_team is not null").withColumn("team", F.upper(F.trim("home_team")))
    return tables.number_rows(g, ["id"], "id", ["team"])


def choropleth_bins(spark, d):
    rates = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("rate"))
    return rates.select("c_nationkey", scales.threshold_bin(F.round("rate", 6), scales.threshold_breaks(3000, 6000, 6)).alias("bin"))


def geo_mercator(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.pmod(F.col("c_custkey") * 37, F.lit(360)).cast("double").alias("lon"), (F.pmod(F.col("c_custkey") * 17, F.lit(160)) - 80).cast("double").alias("lat"))
    x, y = geo.geo_to_canvas(F.col("lon") - 180, F.col("lat"), (-77.0, 38.9), 4, 1000, 800)
    return t.select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def map_tiles(spark, d):
    v = table(spark, d, "viewports").where("minx is not null and miny is not null and maxx is not null and maxy is not null and minx <= maxx and miny <= maxy and not isnan(minx) and not isnan(miny) and not isnan(maxx) and not isnan(maxy)")
    return geo.slippy_tiles(v, "minx", "miny", "maxx", "maxy", 12).select("viewport_id", "tile_x", "tile_y").distinct()


def state_shapes(spark, d):
    """Centres and sizes of GeoJSON squares, one a nation."""
    lon, lat = -120 + F.col("n_nationkey") * 2.0, 30 + F.col("n_nationkey") * 0.5
    corner = lambda a, b: F.array(lon + a, lat + b)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).alias("coordinates"))
    return table(spark, d, "nation").select("n_nationkey", geo.geojson_shape("albers", 960, 500)(F.to_json(shape)).alias("s")).select("n_nationkey", *[F.round(f"s.{c}", 4).alias(c) for c in ("cx", "cy", "width", "height")])


def density_grid(spark, d):
    return density.density_grid(table(spark, d, "lineitem"), "l_quantity", "l_discount", F.lit(1), 2.0).select("cell_x", "cell_y", F.col("weight").cast("long").alias("weight"))


def density_contours(spark, d):
    t = table(spark, d, "dots_skewed_80_20").distinct().where("w between 0 and 100000 and h between 0 and 100000")
    grid = density.blur(density.density_grid(t, "w", "h", F.lit(1.0), 2000.0), 1.5)
    return density.contour_band(grid, [1.0, 5.0, 10.0]).groupBy("band").agg(F.round(F.sum("weight"), 3).alias("weight"))


def contour_pieces(spark, d):
    """Pieces of the contour lines of the raw dots, by threshold."""
    t = table(spark, d, "dots_skewed_80_20").distinct().where("w between 0 and 100000 and h between 0 and 100000")
    grid = density.density_grid(t, "w", "h", F.lit(1.0), 5000.0)
    return density.contour_lines(grid, [2.5, 20.5]).groupBy("threshold").agg(F.count(F.lit(1)).alias("pieces"))


def heat_alpha(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    lo_hi = t.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return t.crossJoin(lo_hi).select("l_quantity", F.round(density.heat_alpha(F.col("n"), F.col("lo"), F.col("hi")), 6).alias("alpha"))


def heat_cells(spark, d):
    t = density.density_grid(table(spark, d, "dots_skewed_80_20").where("w between 0 and 100000 and h between 0 and 100000"), "w", "h", F.lit(1), 5000.0)
    return density.heat_grid(t.withColumn("alpha", F.lit(0.01)), 2).select("cell_x", "cell_y", F.round("heat", 6).alias("heat"), density.ramp_stop(F.round("heat", 6)).alias("stop"))


def stats_rollup(spark, d):
    t = table(spark, d, "stats").where("fetch_time_ms >= 0 and not isnan(fetch_time_ms) and rows_fetched >= 0 and query_type is not null").drop("received_at").distinct()
    return sinks.fetch_statistics(t).select("query_type", "fetches", F.round("mean_ms", 4).alias("mean_ms"), "rows")


def windowed_log(spark, d):
    return _rounded(fetch_log.windowed(table(spark, d, "events"), "ts", ["event_type"], "value"), "total")


def csv_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/nation-csv-{uuid.uuid4().hex}"
    table(spark, d, "nation").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return readers.load_csv(spark, path, "nation_csv", schema="n_nationkey int, n_name string, n_regionkey int")


def schema_scan(spark, d):
    _views(spark, d, "lineitem")
    names = readers.column_names(spark, "SELECT * FROM lineitem WHERE l_quantity > 10")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")


def score_text(spark, d):
    t = table(spark, d, "games").select("id", F.concat_ws(" - ", F.col("home_score").cast("string"), F.col("away_score").cast("string")).alias("s"))
    return t.select("id", scales.swap_score(F.col("s")).alias("swapped"), scales.truncate_label(F.col("s"), 3).alias("label"))


def parsed_numbers(spark, d):
    """The running number of each docket, as the number that its second word starts with."""
    return table(spark, d, "documents").select("doc_id", scales.parse_number(F.substring_index("docket", " ", -1)).alias("v"))


QUERIES = {f.__name__: f for f in (static_agg_pie, static_agg_bar, static_agg_treemap, static_agg_pack, static_agg_cloud, static_agg_stacked, static_agg_filtered, static_sample, pie_angles, stacked_bar_layout, filled_domain, radar_layout, table_rownum, table_rownum_grouped, table_canvas_height, join_two_table, join_self_dim, cross_pairs, games_with_teams, team_grid, choropleth_bins, geo_mercator, map_tiles, state_shapes, density_grid, density_contours, contour_pieces, heat_alpha, heat_cells, stats_rollup, windowed_log, csv_roundtrip, schema_scan, score_text, parsed_numbers)}

_PRIO = "SELECT o_orderpriority, count(*) AS agg_value FROM orders GROUP BY ALL ORDER BY agg_value DESC, o_orderpriority LIMIT 20"
_STACK = "SELECT o_orderpriority, o_orderstatus, count(*) AS agg_value FROM orders GROUP BY ALL ORDER BY agg_value DESC, o_orderpriority, o_orderstatus LIMIT 25"
_PI = math.pi
_MERC = f"-ln(tan({_PI / 4!r}::DOUBLE + radians(lat) / 2)) / {2 * _PI!r}::DOUBLE"
_CX, _CY = math.radians(-77.0) / (2 * _PI) * 4096, -math.log(math.tan(_PI / 4 + math.radians(38.9) / 2)) / (2 * _PI) * 4096

_DOTS = "SELECT DISTINCT * FROM dots_skewed_80_20 WHERE w BETWEEN 0 AND 100000 AND h BETWEEN 0 AND 100000"
_TAPS = [math.exp(-0.5 * (i / 1.5) ** 2) for i in range(-5, 6)]
_KERNEL = "(VALUES " + ", ".join(f"({i - 5}, {v / sum(_TAPS)!r}::DOUBLE)" for i, v in enumerate(_TAPS)) + ")"
_DISC = "(VALUES " + ", ".join(f"({a}, {b}, {1 - math.hypot(a, b) / 2!r}::DOUBLE)" for a in range(-2, 3) for b in range(-2, 3) if math.hypot(a, b) < 2) + ")"
_N = (math.sin(math.radians(29.5)) + math.sin(math.radians(45.5))) / 2
_C = 1 + math.sin(math.radians(29.5)) * (2 * _N - math.sin(math.radians(29.5)))
_R0 = math.sqrt(_C - 2 * _N * math.sin(math.radians(38.7))) / _N
_X0, _Y0 = _R0 * math.sin(_N * math.radians(-0.6)), -_R0 * math.cos(_N * math.radians(-0.6))

ORACLE = {
    "state_shapes": f"""WITH c AS (SELECT n_nationkey, k, -120 + n_nationkey * 2e0 + a AS lon, 30 + n_nationkey * 0.5e0 + b AS lat FROM nation, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS t(k, a, b)),
r AS (SELECT *, sqrt({_C!r}::DOUBLE - {2 * _N!r}::DOUBLE * sin(radians(lat))) / {_N!r}::DOUBLE AS rho, {_N!r}::DOUBLE * radians(lon + 96) AS th FROM c),
p AS (SELECT n_nationkey, k, (rho * sin(th) - ({_X0!r}::DOUBLE)) * 960 + 480 AS x, -(-rho * cos(th) - ({_Y0!r}::DOUBLE)) * 960 + 250 AS y FROM r),
q AS (SELECT *, lead(x, 1, first_x) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2 FROM (SELECT *, first_value(x) OVER v AS first_x, first_value(y) OVER v AS first_y FROM p WINDOW v AS (PARTITION BY n_nationkey ORDER BY k)) WINDOW w AS (PARTITION BY n_nationkey ORDER BY k)),
s AS (SELECT n_nationkey, sum(x * y2 - x2 * y) / 2 AS area, sum((x + x2) * (x * y2 - x2 * y)) / 6 AS sx, sum((y + y2) * (x * y2 - x2 * y)) / 6 AS sy, max(x) - min(x) AS width, max(y) - min(y) AS height FROM q GROUP BY ALL)
SELECT n_nationkey, round(sx / area, 4) AS cx, round(sy / area, 4) AS cy, round(width, 4) AS width, round(height, 4) AS height FROM s""",
    "density_contours": f"""WITH d AS ({_DOTS}), g AS (SELECT CAST(floor(w / 2000.0) AS BIGINT) AS x, CAST(floor(h / 2000.0) AS BIGINT) AS y, count(*)::DOUBLE AS n FROM d GROUP BY ALL),
b AS (SELECT x + i AS x, y, sum(n * k) AS n FROM g, {_KERNEL} AS t(i, k) GROUP BY ALL), c AS (SELECT x, y + i AS y, sum(n * k) AS n FROM b, {_KERNEL} AS t(i, k) GROUP BY ALL)
SELECT (n >= 1)::INT + (n >= 5)::INT + (n >= 10)::INT AS band, round(sum(n), 3) AS weight FROM c GROUP BY ALL""",
    "contour_pieces": f"""WITH d AS ({_DOTS}), g AS (SELECT CAST(floor(w / 5000.0) AS BIGINT) AS x, CAST(floor(h / 5000.0) AS BIGINT) AS y, count(*)::DOUBLE AS n FROM d GROUP BY ALL),
s AS (SELECT x - i AS x, y - j AS y, sum(CASE WHEN i = 0 AND j = 0 THEN n ELSE 0 END) AS a, sum(CASE WHEN i = 1 AND j = 0 THEN n ELSE 0 END) AS b, sum(CASE WHEN i = 1 AND j = 1 THEN n ELSE 0 END) AS c, sum(CASE WHEN i = 0 AND j = 1 THEN n ELSE 0 END) AS e
  FROM g, (VALUES (0), (1)) AS p(i), (VALUES (0), (1)) AS q(j) GROUP BY ALL),
t AS (SELECT t AS threshold, (a >= t)::INT AS a, (b >= t)::INT AS b, (c >= t)::INT AS c, (e >= t)::INT AS e FROM s, (VALUES (2.5e0), (20.5e0)) AS u(t))
SELECT threshold, sum(CASE WHEN a = c AND b = e AND a <> b THEN 2 ELSE 1 END)::BIGINT AS pieces FROM t WHERE a + b + c + e BETWEEN 1 AND 3 GROUP BY ALL""",
    "heat_cells": f"""WITH d AS (SELECT * FROM dots_skewed_80_20 WHERE w BETWEEN 0 AND 100000 AND h BETWEEN 0 AND 100000), g AS (SELECT DISTINCT CAST(floor(w / 5000.0) AS BIGINT) AS x, CAST(floor(h / 5000.0) AS BIGINT) AS y FROM d),
s AS (SELECT x + i AS cell_x, y + j AS cell_y, round(least(1e0, sum(0.01e0 * k)), 6) AS heat FROM g, {_DISC} AS t(i, j, k) GROUP BY ALL)
SELECT *, CASE WHEN heat < 0.25 THEN 0 WHEN heat < 0.55 THEN 1 WHEN heat < 0.85 THEN 2 ELSE 3 END AS stop FROM s""",
    "static_agg_pie": _PRIO,
    "static_agg_bar": "SELECT p_brand, round(max(p_retailprice), 4) AS agg_value FROM part GROUP BY ALL ORDER BY max(p_retailprice) DESC, p_brand LIMIT 25",
    "static_agg_treemap": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS agg_value FROM lineitem GROUP BY ALL ORDER BY agg_value DESC, l_returnflag, l_linestatus LIMIT 80",
    "static_agg_pack": "SELECT p_type, count(p_partkey) AS agg_value FROM part GROUP BY ALL ORDER BY agg_value DESC, p_type LIMIT 150",
    "static_agg_cloud": """WITH c AS (SELECT p_brand, min(p_size) AS agg_value FROM part GROUP BY ALL ORDER BY agg_value DESC, p_brand LIMIT 100)
SELECT p_brand, agg_value, 10e0 + CASE WHEN max(agg_value) OVER () = min(agg_value) OVER () THEN 1e0 ELSE (agg_value - min(agg_value) OVER ()) / (max(agg_value) OVER () - min(agg_value) OVER ())::DOUBLE END * 50e0 AS font_size FROM c""",
    "static_agg_stacked": _STACK,
    "static_agg_filtered": "SELECT l_linestatus, round(avg(l_quantity), 4) AS agg_value FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL",
    "static_sample": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 75",
    "pie_angles": f"""WITH p AS ({_PRIO}), w AS (SELECT *, sum(agg_value) OVER () AS t, sum(agg_value) OVER (ORDER BY agg_value DESC, o_orderpriority ROWS UNBOUNDED PRECEDING) AS u FROM p)
SELECT o_orderpriority, round(agg_value / t::DOUBLE, 6) AS share, round((u - agg_value) / t::DOUBLE * {2 * _PI!r}::DOUBLE, 6) AS start_angle, round(u / t::DOUBLE * {2 * _PI!r}::DOUBLE, 6) AS end_angle FROM w""",
    "stacked_bar_layout": f"WITH s AS ({_STACK}) SELECT *, CAST(sum(agg_value) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bar_height, CAST(sum(agg_value) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS bar_total FROM s",
    "filled_domain": """SELECT s AS o_orderstatus, p AS o_orderpriority, coalesce(n, 0) AS n FROM unnest(['F', 'O', 'P', 'Q']) AS a(s), unnest(['1-URGENT', '9-NONE']) AS b(p)
LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) ON o_orderstatus = s AND o_orderpriority = p""",
    "radar_layout": f"""WITH a AS (SELECT l_returnflag, avg(l_quantity) / 50 * 100 AS q, avg(l_discount) / 0.1 * 100 AS c, avg(l_tax) / 0.1 * 100 AS t FROM lineitem GROUP BY ALL),
u AS (SELECT l_returnflag, 'q' AS measure, 0 AS i, q AS r FROM a UNION ALL SELECT l_returnflag, 'c', 1, c FROM a UNION ALL SELECT l_returnflag, 't', 2, t FROM a)
SELECT l_returnflag, measure, round(r * cos({_PI / 2!r}::DOUBLE + i * {2 * _PI / 3!r}::DOUBLE), 6) AS px, round(-r * sin({_PI / 2!r}::DOUBLE + i * {2 * _PI / 3!r}::DOUBLE), 6) AS py FROM u""",
    "table_rownum": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "table_rownum_grouped": """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT *, 50e0 + 40e0 * (rn - 0.5e0) AS cell_y FROM n""",
    "table_canvas_height": "SELECT count(*) * 40 + 50 AS height FROM orders WHERE o_orderstatus = 'F'",
    "join_two_table": "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_acctbal < 0",
    "join_self_dim": "SELECT a.n_name AS one, b.n_name AS two, r.r_name FROM nation a, nation b, region r WHERE a.n_regionkey = r.r_regionkey AND b.n_regionkey = r.r_regionkey AND a.n_nationkey < b.n_nationkey",
    "cross_pairs": "SELECT a.r_name AS one, b.r_name AS two FROM region a, region b",
    "games_with_teams": """WITH t AS (SELECT DISTINCT abbr, city FROM teams), g AS (SELECT id, upper(trim(home_team)) AS home, upper(trim(away_team)) AS away FROM games)
SELECT g.id, home, h.city AS home_city, away, a.city AS away_city FROM g JOIN t h ON h.abbr = home JOIN t a ON a.abbr = away""",
    "team_grid": "SELECT id, upper(trim(home_team)) AS team, row_number() OVER (PARTITION BY upper(trim(home_team)) ORDER BY id) AS rn FROM games WHERE home_team IS NOT NULL",
    "choropleth_bins": "WITH r AS (SELECT c_nationkey, round(avg(c_acctbal), 6) AS v FROM customer GROUP BY ALL) SELECT c_nationkey, CAST((v >= 3000)::INT + (v >= 3500)::INT + (v >= 4000)::INT + (v >= 4500)::INT + (v >= 5000)::INT + (v >= 5500)::INT AS INTEGER) AS bin FROM r",
    "geo_mercator": f"""WITH p AS (SELECT c_custkey, c_custkey * 37 % 360 - 180e0 AS lon, (c_custkey * 17 % 160) - 80e0 AS lat FROM customer)
SELECT c_custkey, round(radians(lon) / {2 * _PI!r}::DOUBLE * 4096e0 - ({_CX - 500!r}::DOUBLE), 4) AS x, round({_MERC} * 4096e0 - ({_CY - 400!r}::DOUBLE), 4) AS y FROM p""",
    "map_tiles": """WITH v AS (SELECT * FROM viewports WHERE minx <= maxx AND miny <= maxy AND NOT isnan(minx) AND NOT isnan(miny) AND NOT isnan(maxx) AND NOT isnan(maxy) AND miny < 1048576 AND maxy >= 0),
x AS (SELECT *, unnest(range(CAST(floor(minx / 256) AS BIGINT), CAST(floor(maxx / 256) AS BIGINT) + 1)) AS tx FROM v),
y AS (SELECT *, unnest(range(greatest(0, CAST(floor(miny / 256) AS BIGINT)), least(4095, CAST(floor(maxy / 256) AS BIGINT)) + 1)) AS ty FROM x)
SELECT DISTINCT viewport_id, ((tx % 4096) + 4096) % 4096 AS tile_x, ty AS tile_y FROM y""",
    "density_grid": "SELECT CAST(floor(l_quantity / 2) AS BIGINT) AS cell_x, CAST(floor(l_discount / 2) AS BIGINT) AS cell_y, count(*) AS weight FROM lineitem GROUP BY ALL",
    "heat_alpha": "WITH t AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_quantity, round(least(1e0, greatest(0.01e0, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())::DOUBLE)), 6) AS alpha FROM t",
    "stats_rollup": "WITH t AS (SELECT DISTINCT * EXCLUDE (received_at) FROM stats WHERE fetch_time_ms >= 0 AND NOT isnan(fetch_time_ms) AND rows_fetched >= 0 AND query_type IS NOT NULL) SELECT query_type, count(*) AS fetches, round(avg(fetch_time_ms), 4) AS mean_ms, CAST(sum(rows_fetched) AS BIGINT) AS rows FROM t GROUP BY ALL",
    "windowed_log": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "csv_roundtrip": "SELECT * FROM nation",
    "schema_scan": "SELECT cid AS i, name FROM pragma_table_info('lineitem')",
    "score_text": """WITH t AS (SELECT id, concat_ws(' - ', home_score, away_score) AS s, home_score AS h, away_score AS a FROM games)
SELECT id, CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN concat_ws(' - ', a, h) ELSE s END AS swapped, CASE WHEN length(s) > 3 THEN s[1:3] || '...' ELSE s END AS label FROM t""",
    "parsed_numbers": "SELECT doc_id, coalesce(try_cast(regexp_extract(string_split(docket, ' ')[-1], '^-?[0-9]+([.][0-9]+)?') AS DOUBLE), 0e0) AS v FROM documents",
}
