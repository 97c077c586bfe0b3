"""Specifications, predicates, viewport functions, pyramids, tables, engine, sinks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoomloom.engine import Engine, opacity_by
from zoomloom.functions import geo, scales
from zoomloom.functions.hull import convex_hull, hull_points
from zoomloom.operators import charts, density, layouts, mutations, pyramid, tables, viewport
from zoomloom.operators.placement import Placement, place
from zoomloom.operators.pyramid import PyramidSpec, build_pyramid, choose_heads, greedy_sequence, join_heads, mark_size, overlap_threshold
from zoomloom.operators.viewport import Box
from zoomloom.sources import dumps, manifest, readers, sinks, synthetic
from zoomloom.spec import navigation
from zoomloom.spec.model import LITERAL_IN, LITERAL_OUT, Canvas, Jump, Layer, Project, SpecError, Transform, View, computed, fingerprint, stale_layers, zoom_levels
from zoomloom.spec.predicates import Both, Either, Equals, Everything, PredicateError, from_json, holds, parse_wire, to_column, to_wire
from zoomloom.spec.templates import ChartTemplate, MapTemplate, PyramidTemplate, TableTemplate, add_chart, add_map, add_pyramid, add_table

MARK = Placement("col:x", "col:y", "con:10", "con:10")


# predicates


def test_predicates_round_trip():
    tree = {"AND": [{"==": ["a", "1"]}, {"OR": [{"==": ["b", "x y"]}, {"==": ["b", "z"]}]}]}
    p = from_json(tree)
    assert p == Both(Equals("a", "1"), Either(Equals("b", "x y"), Equals("b", "z")))
    assert parse_wire(to_wire(p), ["A", "b"]) == Both(Equals("A", "1"), Either(Equals("b", "x y"), Equals("b", "z")))
    assert from_json({}) == Everything() and parse_wire("  ", []) == Everything()
    assert to_wire(Both(Everything(), Equals("a", "1"))) == "(a='1')"


@pytest.mark.parametrize("bad", ["a='1'", "(a=1)", "(c='1')", "(a='1' OR)", "((a='1') (b='2'))", "(a='1'", "(a='x'y')", "((a='1') XOR (b='2'))", "(a='1') AND (b='2')", "(a='1'; DROP TABLE x)"])
def test_bad_predicates(bad):
    with pytest.raises(PredicateError):
        parse_wire(bad, ["a", "b"])


def test_predicate_columns(spark):
    df = spark.createDataFrame([(1, "u"), (2, None), (None, "u")], "a int, b string")
    p = parse_wire("((a='1') OR (b='u'))", ["a", "b"])
    assert df.where(to_column(p)).count() == 2
    assert df.where(~to_column(p)).count() == 1, "null never matches"
    assert [holds(p, r.asDict()) for r in df.collect()] == [True, False, True]
    assert navigation.highlight(df, Everything()).where("opacity = 1").count() == 3


# specifications


def project():
    p = Project("p")
    t = Transform("SELECT * FROM pts", columns=("id", "x", "y"))
    p.add_canvas(Canvas("top", 1000, 1000, (Layer(t, placement=MARK), Layer(t, placement=MARK, fetching="tiling"))))
    p.add_canvas(Canvas("low", 2000, 2000, (Layer(t, placement=MARK, delta=False, updates=True),)))
    p.add_view(View("v", 200, 200, "top"))
    p.add_jump(Jump("top", "low", LITERAL_IN))
    p.add_jump(Jump("low", "top", LITERAL_OUT))
    return p


def test_project_is_valid():
    p = project()
    p.check()
    assert zoom_levels(p) == {"top": 0, "low": 1}
    assert stale_layers(p, p) == [] and len(stale_layers(None, p)) == 3


BROKEN = [
    lambda: Canvas("c", 0, 5),
    lambda: Layer(None),
    lambda: Layer(Transform("q"), fetching="other"),
    lambda: Layer(Transform("q"), static=True, fetching="tiling"),
    lambda: Transform("q", function=lambda d: d),
    lambda: Jump("a", "b", "fly"),
    lambda: Jump("a", "b", "slide", slide_direction=360),
    lambda: Jump("a", "b", "load", source_view="u", dest_view="v"),
    lambda: Jump("a", "b", LITERAL_IN, selector=lambda r, a: True),
    lambda: project().add_view(View("v", 1, 1)),
    lambda: project().add_canvas(Canvas("top", 1, 1)),
    lambda: project().add_jump(Jump("top", "nowhere", "semantic_zoom")),
    lambda: project().add_jump(Jump("top", "low", LITERAL_IN)),
    lambda: Placement("x", "col:y", "con:1", "con:1"),
    lambda: PyramidSpec("i", "x", "y", "z", (0, 0), (0, 1)),
    lambda: PyramidSpec("i", "x", "y", "z", (0, 1), (0, 1), topk=9),
    lambda: PyramidTemplate(PyramidSpec("i", "x", "y", "z", (0, 1), (0, 1)), "SELECT * FROM t LIMIT 5"),
    lambda: PyramidTemplate(PyramidSpec("i", "x", "y", "z", (0, 1), (0, 1), dimensions=("d",)), "SELECT 1", "circle"),
    lambda: PyramidTemplate(PyramidSpec("i", "x", "y", "z", (0, 1), (0, 1), measures=("m",)), "SELECT 1", "dot"),
    lambda: ChartTemplate("q", "pie", ("a",), "MEDIAN(x)"),
    lambda: ChartTemplate("q", "pie", ("a",), "COUNT(*)", stack=("b",)),
    lambda: ChartTemplate("q", "bar", ("a",), "COUNT(*)", stack=("a",)),
    lambda: ChartTemplate("q", "bar", ("a",), "SUM(a)"),
    lambda: ChartTemplate("q", "bar", ("a",), "SUM(b)", aliases=("x",)),
    lambda: PyramidTemplate(PyramidSpec("i", "x", "y", "z", (0, 1), (0, 1), measures=("m", "n")), "SELECT 1", "radar", radar_extents=((0, 1),)),
    lambda: computed("my-table", {"x": "a"}),
    lambda: computed("t", {}),
    lambda: computed("t", {"x y": "a"}),
    lambda: computed("t", {"x": "1 + 2"}),
    lambda: computed("t", {"x": "a", "X": "b"}),
    lambda: computed("t", {"x": "a; DROP TABLE t"}),
    lambda: Layer(Transform("q"), layout="heap"),
    lambda: Layer(Transform("q"), indexer="other"),
    lambda: TableTemplate("t", ("a", "b"), "a", widths=(1,)),
    lambda: TableTemplate("t", ("a",), ""),
    lambda: MapTemplate("s", "r", colors=9),
    lambda: MapTemplate("s", "r", zoom_factor=4),
]


@pytest.mark.parametrize("make", BROKEN)
def test_broken_specs(make):
    with pytest.raises(ValueError):
        make()


def test_check_rejects_project_faults():
    for change in ("layerless", "outside", "placement"):
        p = project()
        if change == "layerless":
            p.canvases["x"] = Canvas("x", 5, 5)
        if change == "outside":
            p.views["w"] = View("w", 200, 200, "top", 900, 0)
        if change == "placement":
            p.canvases["x"] = Canvas("x", 5, 5, (Layer(Transform("q", columns=("a",)), placement=MARK),))
        with pytest.raises(SpecError):
            p.check()
    p = Project("z")
    p.canvases |= {"a": Canvas("a", 10, 10), "b": Canvas("b", 20, 40)}
    with pytest.raises(SpecError):
        p.add_jump(Jump("a", "b", LITERAL_IN))


def test_templates():
    p = Project("t")
    made = add_pyramid(p, PyramidTemplate(PyramidSpec("i", "x", "y", "z", (0, 1), (0, 1), levels=2), "SELECT * FROM t"))
    assert [c.w for c in made] == [1000, 2000, 4000] and zoom_levels(p)[made[2].id] == 2
    assert add_table(p, TableTemplate("t", ("a", "b"), "a", widths=(30, 41))).w == 71
    assert len(add_chart(p, ChartTemplate("q", "bar", ("a",), "SUM(x)", sample=("s",))).layers) == 2
    assert len(add_map(p, MapTemplate("s", "r", "c"))) == 2


def test_navigation():
    p = project()
    j = p.add_jump(Jump("top", "low", "semantic_zoom", selector=lambda row, args: row["id"] > 1, predicates=lambda row: {"layer0": {"==": ["id", str(row["id"])]}}, viewport=lambda row: {"centroid": {"layer0": {"==": ["id", "2"]}}}))
    assert navigation.applicable(p, "top", {"id": 1}, {})[-1] is not j
    t = navigation.follow(p, j, p.views["v"], {"id": 2}, lambda i, q: (500.0, 400.0))
    assert t.corner == (400.0, 300.0) and t.predicates == (Equals("id", "2"),)
    assert navigation.axis_range((10, 20), 100, -5, 50) == (10, 15)
    assert navigation.slide((0, 0), (10, 20), 90) == (pytest.approx(0), -20)
    assert navigation.jump_name(j, {"id": 2}) == "semantic_zoom to low"
    assert [navigation.jump_name(Jump("a", "b", "slide", slide_direction=0, name=n), {"id": 2}) for n in ("on", lambda row: f"to {row['id']}")] == ["on", "to 2"]


# viewports


def test_viewport_functions():
    assert viewport.dynamic_box(0, 0, 100, 100, 1000, 1000) == Box(-10, -10, 190, 190)
    assert viewport.needs_fetch(0, 0, 100, 100, None, 1000, 1000)
    box = viewport.dynamic_box(450, 450, 100, 100, 1000, 1000)
    assert not viewport.needs_fetch(450, 450, 100, 100, box, 1000, 1000) and viewport.needs_fetch(405, 450, 100, 100, box, 1000, 1000)
    assert viewport.viewport_tiles(1000, 0, 100, 10, 5000, 5000) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        viewport.check_tile(100, 0)
    assert viewport.kd_route([10.0, 20.0, 30.0], Box(12, 0, 20, 1)) == [1, 2]


@pytest.mark.parametrize("seed", range(8))
def test_difference_covers(seed):
    r = random.Random(seed)
    b = lambda: Box(*(lambda a, c: (min(a), min(c), max(a), max(c)))([r.randint(0, 20), r.randint(0, 20)], [r.randint(0, 20), r.randint(0, 20)]))
    new, old = b(), b()
    parts = viewport.difference(new, old)
    for _ in range(200):
        x, y = r.uniform(0, 20), r.uniform(0, 20)
        inside = lambda q: q.minx < x < q.maxx and q.miny < y < q.maxy
        assert sum(map(inside, parts)) == (inside(new) and not inside(old))


def test_written_layer_and_static(spark, tmp_path):
    df = place(synthetic.uniform_points(spark, 2000, 1000, 1000).withColumns({"x": F.col("w"), "y": F.col("h")}), MARK)
    old, new = Box(100, 100, 200, 200), Box(150, 120, 330, 210)
    want = {b: {r["id"] for r in viewport.in_box(df, b).collect()} for b in (old, new)}
    for layout in layouts.LAYOUTS:
        path = f"{tmp_path}/{layout}"
        layouts.write(df, path, Box(0, 0, 1000, 1000), layout, side=64)
        back = layouts.Written(spark, path)
        assert sorted(r["id"] for r in back.rows().collect()) == list(range(2000)), layout
        for b in (old, new):
            got = [r["id"] for r in back.in_box(b).collect()]
            assert len(got) == len(set(got)) and set(got) == want[b], layout
        assert {r["id"] for r in back.added(new, old).collect()} == want[new] - want[old]
    plan = layouts.Written(spark, f"{tmp_path}/box").in_box(old)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(maxx)" in plan
    assert place(df.select("id"), None, static=True).where("minx = 0 and maxx = 0").count() == 2000


# pyramids


def cloud(n, seed, chain=False):
    r = np.random.default_rng(seed)
    x = np.arange(n) * 5.0 if chain else np.round(r.uniform(0, 300, n), 1)
    y = np.zeros(n) if chain else np.round(r.uniform(0, 300, n), 1)
    z = np.arange(n) * 1.0 if chain else r.integers(0, 20, n) * 1.0
    return z, np.arange(n), x, y


@pytest.mark.parametrize("seed,chain", [(1, False), (2, False), (3, True)])
def test_heads_equal_sequential(spark, seed, chain):
    z, i, x, y = cloud(60 if chain else 200, seed, chain)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(e)) for a, b, c, e in zip(i, z, x, y)], "id long, z double, x double, y double")
    want = set(i[greedy_sequence(z, i, x, y, 15.0, 20.0)].tolist())
    for prefix, tile_rows, side in ((8, 100_000, 256), (1, 20, 4), (3, 50, 6)):
        heads = choose_heads(df, 15.0, 20.0, prefix, tile_rows, side)
        assert {r["id"] for r in heads.collect()} == want
    member = {r["id"]: r["head"] for r in join_heads(df, heads, 15.0, 20.0).collect()}
    order = {int(k): n for n, k in enumerate(i[np.lexsort((i, z))])}
    for k in range(len(x)):
        near = [(max(abs(x[k] - x[h]) / 15, abs(y[k] - y[h]) / 20), order[h], h) for h in want if abs(x[k] - x[h]) <= 15 and abs(y[k] - y[h]) <= 20 and order[h] <= order[k]]
        assert member[k] == min(near)[2]


def test_long_chain_and_crowded_cell(spark):
    """A chain of 3 000 points that each depend on the one before, and 2 000 points in one cell, over many tiles."""
    z, i, x, y = cloud(3000, 0, True)
    r = np.random.default_rng(1)
    x, y = np.concatenate([x, 20_000 + r.uniform(0, 30, 2000)]), np.concatenate([y, r.uniform(0, 30, 2000)])
    i, z = np.arange(5000), np.concatenate([z, r.uniform(0, 3000, 2000)])
    df = spark.createDataFrame([(int(a), float(b), float(c), float(e)) for a, b, c, e in zip(i, z, x, y)], "id long, z double, x double, y double")
    want = set(i[greedy_sequence(z, i, x, y, 15.0, 20.0)].tolist())
    assert {r["id"] for r in choose_heads(df, 15.0, 20.0, tile_rows=1000).collect()} == want


def test_pyramid_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 2.0, 3.0)], "id long, x double, y double, z double")
    p = build_pyramid(df, PyramidSpec("id", "x", "y", "z", (0, 100), (0, 100), levels=1))
    assert p.levels.count() == p.aggregates.count() == p.hulls.count() == p.members.count() == p.top.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_hull_points(seed):
    xy = np.random.default_rng(seed).integers(0, 40, (400, 2)).astype(float)
    assert [tuple(p) for p in hull_points(xy).tolist()] == convex_hull(xy.tolist())


def test_pyramid_invariants(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), float(a), float(b), float(c), "uv"[i % 2], float(v)) for i, (a, b, c, v) in enumerate(r.uniform(0, 100, (300, 4)))] + [(900, None, 1.0, 1.0, "u", 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, d string, m double")
    p = build_pyramid(df, PyramidSpec("id", "x", "y", "z", (0, 100), (0, 100), levels=2, top_width=400, top_height=400, mark_w=40, mark_h=40, theta=1.0, measures=("m",), dimensions=("d",)))
    levels = {}
    for row in p.levels.collect():
        levels.setdefault(row["level"], {})[row["id"]] = (row["x"], row["y"])
    assert set(levels[0]) <= set(levels[1]) <= set(levels[2])
    for heads in levels.values():
        at = list(heads.values())
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 40 for n, a in enumerate(at) for b in at[:n])
    n = {row["level"]: row["n"] for row in p.aggregates.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert n == {0: 300, 1: 300, 2: 300}
    total = p.aggregates.groupBy("level").agg(F.sum("sum_m").alias("s")).collect()
    assert all(row["s"] == pytest.approx(sum(v[5] for v in rows[:300])) for row in total)
    assert p.top.where("place > 3").count() == 0
    hull = {(row["level"], row["head"]): [(q["x"], q["y"]) for q in row["hull"]] for row in p.hulls.collect()}
    own = {}
    for row in p.members.collect():
        own.setdefault((row["level"], row["head"]), []).append((rows[row["id"]][1], rows[row["id"]][2]))
    assert hull == {k: convex_hull(v) for k, v in own.items()}
    assert {(r["level"], r["head"]): (r["minx"], r["maxy"]) for r in pyramid.hover_box(p.hulls).collect()} == {k: (min(a for a, _ in v), max(b for _, b in v)) for k, v in own.items()}
    merged = pyramid.merge_aggregates(p.aggregates, ["level"], ["m"]).collect()
    assert all(row["avg_m"] == pytest.approx(np.mean([v[5] for v in rows[:300]])) for row in merged)
    keys = pyramid.cluster_keys(p.aggregates, ["d"], ["m"], ["avg"]).first()["cluster_agg"]
    assert all(k.split("__")[0] in "uv" for k in keys)


def test_pyramid_helpers():
    assert overlap_threshold(140, 140, 0.0) == 0.2 and overlap_threshold(10, 10, 0) == pytest.approx((4 * 1020 * 1020 // 4000 // 10 // 10) ** 0.5 - 1)
    assert mark_size("heatmap", 20) == (41, 41) and mark_size("dot", 5) == (12, 12) and mark_size("pie") == (290, 290)
    assert convex_hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


# functions, tables, charts


def test_scales():
    assert scales.threshold_breaks(0, 10, 5) == [0, 2, 4, 6, 8]
    assert scales.invert(5, (0, 100), (0, 10)) == 50
    assert scales.short_number(1234567) == "1.235M" and scales.short_number(0) == "0"
    with pytest.raises(ValueError):
        scales.linear(None, (1, 1), (0, 1))
    assert density.contour_thresholds(1000, 0) == pytest.approx([1e-4 + i * 0.07 / 6 for i in range(6)]) and density.contour_thresholds(0, 3) == []


def test_numbers(spark):
    back = spark.range(5).select(scales.invert_column(scales.linear(F.col("id"), (0, 4), (10, 90)), (0, 4), (10, 90)).alias("v"))
    assert [r["v"] for r in back.collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert [r["opacity"] for r in opacity_by(spark.range(3), F.col("id") == 1).collect()] == [0.4, 1.0, 0.4]
    df = spark.createDataFrame([("1,234.5x",), ("-7",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(scales.parse_number(F.col("t"))).collect()] == [1234.5, -7.0, 0.0, 0.0]
    d = spark.createDataFrame([(2020, 2, 30), (2017, 10, 17)], "y int, m int, d int")
    assert [r[0] for r in d.select(scales.time_position(F.col("y"), F.col("m"), F.col("d"), "2017-10-17", "2018-04-11", (82, 918))).collect()] == [None, 82.0]


def test_table_numbers(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "a int, b int")
    got = {r["a"]: r["rn"] for r in tables.number_rows(df, ["a"], "b desc, a").collect()}
    assert got == {a: n + 1 for n, (a, _) in enumerate(sorted(((a, a % 7) for a in range(500)), key=lambda r: (-r[1], r[0])))}
    assert tables.number_rows(df.limit(0), ["a"], "a").count() == 0
    with pytest.raises(ValueError):
        tables.parse_order("a sideways")


def test_numbers_of_a_hot_group(spark):
    """A group of two thirds of the rows is numbered over many partitions; nulls are a group of their own."""
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"g{i % 30}", (i * 7919) % 1009) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, g string, b int").repartition(7)
    got = {r["a"]: r["rn"] for r in tables.number_rows(df, ["a"], "b desc, a", ["g"]).collect()}
    want, seen = {}, {}
    for a, g, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[a] = seen[g] = seen.get(g, 0) + 1
    assert got == want and tables.number_rows(df.limit(0), ["a"], "a", ["g"]).count() == 0 == tables.number_rows(df.limit(0), ["a"], "a").count()


def test_contour_lines(spark):
    """Lines of a cone are closed, keep the high side on the left, and lie where the density has the threshold."""
    cells = [(x, y, max(0.0, 10 - math.hypot(x, y))) for x in range(-12, 13) for y in range(-12, 13)] + [(30, 30, 5.0), (31, 31, 5.0)]
    df = spark.createDataFrame(cells, "cell_x long, cell_y long, weight double")
    rows = density.contour_lines(df, [4.0, 6.5], 1.0).collect()
    for t in (4.0, 6.5):
        own = [r for r in rows if r["threshold"] == t and r["x0"] < 25]
        ends = lambda r: ((round(r["x0"], 9), round(r["y0"], 9)), (round(r["x1"], 9), round(r["y1"], 9)))
        assert sorted(ends(r)[0] for r in own) == sorted(ends(r)[1] for r in own), "every piece goes on in another"
        assert all(abs(10 - math.hypot(r["x0"] - 0.5, r["y0"] - 0.5) - t) < 0.1 for r in own)
        area = sum((r["x0"] - 0.5) * (r["y1"] - 0.5) - (r["x1"] - 0.5) * (r["y0"] - 0.5) for r in own) / 2
        assert area == pytest.approx(math.pi * (10 - t) ** 2, rel=0.05)
    saddle = [r for r in rows if r["threshold"] == 4.0 and r["x0"] > 25]
    assert len(saddle) == 8 and sorted((r["x0"], r["y0"]) for r in saddle) == sorted((r["x1"], r["y1"]) for r in saddle), "two cells that touch at a corner stay apart"


def test_maps_and_leaves(spark):
    df = spark.createDataFrame([(1, {"count(*)": 2.0, "min(a)": 1.0, "u__max(a)": 5.0, "avg(a)": 3.0}), (1, {"count(*)": 3.0, "min(a)": -1.0, "u__max(a)": 4.0})], "k int, m map<string,double>")
    assert pyramid.merge_maps(df, ["k"], "m").first()["m"] == {"count(*)": 5.0, "min(a)": -1.0, "u__max(a)": 5.0}
    leaf = viewport.by_leaf(spark.range(100).withColumn("cx", F.col("id").cast("double")), [24.0, 49.0, 74.0])
    assert sorted((r["p"], r["count"]) for r in leaf.groupBy(F.spark_partition_id().alias("p"), "leaf").count().collect()) == [(0, 25), (1, 25), (2, 25), (3, 25)]
    one = charts.chart(spark.range(30).withColumn("d", F.col("id") % 10), "pie", ["d"], "COUNT(*)", palette=["a", "b", "c"])
    assert one.count() == 3


def test_rows_and_tables(spark, tmp_path):
    df = spark.range(10).repartition(3)
    parts = list(readers.rows_as_text(df, 4))
    assert [len(p) for p in parts] == [4, 4, 2] and sorted(int(r[0]) for p in parts for r in p) == list(range(10))
    more = mutations.insert_rows(spark.createDataFrame([(1, "a")], "k int, s string"), spark.createDataFrame([(2, 3)], "k int, other int"))
    assert sorted((r["k"], r["s"] or "") for r in more.collect()) == [(1, "a"), (2, "")]
    assert mutations.change_columns(more, {"t": F.lit(1)}, ["s"]).columns == ["k", "t"]
    sinks.write_table(more, f"{tmp_path}/parts", ["k"])
    sinks.write_table(more, f"{tmp_path}/parts", ["k"])
    assert spark.read.parquet(f"{tmp_path}/parts").where("k = 1").count() == 1
    c = readers.Connections(spark)
    with pytest.raises(KeyError):
        c.read("db", "t")
    folder = f"{tmp_path}/t"
    for v in (1, 2, 3):
        manifest.save_table(spark.range(100).withColumn("v", F.lit(v)), folder)
        assert manifest.read_table(spark, folder).select("v").distinct().collect() == [(v,)]
    files = len(manifest.manifest(spark, folder)["files"])
    hit = lambda df: df.where("id = 5")
    assert manifest.change_table(spark, folder, hit, lambda df: df.withColumn("v", F.when(F.col("id") == 5, 9).otherwise(F.col("v")))) == 1
    assert len(manifest.manifest(spark, folder)["files"]) == files and manifest.change_table(spark, folder, lambda df: df.where("id = 500"), None) == 0
    assert {(r["id"], r["v"]) for r in manifest.read_table(spark, folder).collect()} == {(i, 9 if i == 5 else 3) for i in range(100)}


def test_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text(
        "-- a dump\nSET x = 1;\nCREATE TABLE public.a (\n    id integer NOT NULL,\n    t text,\n    n numeric(10,2),\n    ok boolean,\n    PRIMARY KEY (id)\n);\n"
        "COPY public.a (id, t, n) FROM stdin;\n1\tx\\ty\\\\n\t1.50\n2\t\\N\t\\N\n3\t);\t7\n\\.\n"
        "INSERT INTO a VALUES (4, 'it''s (a), b', NULL, true), (5, 'NULL', -2, false);\nCREATE TABLE none (k int);\nCOPY c (u) FROM stdin;\nCOPY d (v) FROM stdin;\n\\.\n"
    )
    found = dumps.load_dump(spark, str(tmp_path / "d.sql"))
    assert set(found) == {"a", "none", "c"} and found["a"].dtypes == [("id", "int"), ("t", "string"), ("n", "double"), ("ok", "boolean")]
    assert sorted(map(tuple, found["a"].collect())) == [(1, "x\ty\\n", 1.5, None), (2, None, None, None), (3, ");", 7.0, None), (4, "it's (a), b", None, True), (5, "NULL", -2.0, False)]
    assert found["none"].count() == 0 and [tuple(r) for r in spark.table("c").collect()] == [("COPY d (v) FROM stdin;",)]


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from zoomloom import session

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://m:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)
    t = session.materialize(spark.range(5))
    assert t.count() == 5
    session.discard(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._written_at).count()


def test_charts():
    rects = charts.treemap([6, 6, 4, 3, 2, 2, 1], 6, 4)
    assert sum(w * h for _, _, w, h in rects) == pytest.approx(24)
    radii = [5, 4, 4, 3, 2, 1, 1]
    at = charts.pack_circles(radii)
    assert all(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 >= (p + q) * (1 - 1e-6) for i, (a, p) in enumerate(zip(at, radii)) for b, q in list(zip(at, radii))[:i])
    assert charts.domain_keys([["a", "b"], ["x"]]) == [("a", "x"), ("b", "x")]
    with pytest.raises(ValueError):
        charts.measure_column("SUM(a) FROM x")


def test_colors(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "k string")
    got = {(r["k"], r["color"]) for r in charts.ordinal_colors(df, "k", ["red", "blue"]).collect()}
    assert got == {(None, "red"), ("a", "blue"), ("b", "red"), ("c", "blue")}


def test_shapes():
    import json

    square = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]})
    assert geo.shape_of(square, lambda a, b: (a, b)) == pytest.approx((1, 1, 2, 2))
    assert geo.shape_of("no json", geo.albers_usa) == geo.shape_of(None, geo.albers_usa) == (0, 0, 0, 0)


# engine, sinks, updates


def test_engine(spark, tmp_path):
    points = synthetic.uniform_points(spark, 3000, 1000, 1000).select("id", F.col("w").alias("x"), F.col("h").alias("y"))
    points.write.parquet(f"{tmp_path}/pts")
    spark.read.parquet(f"{tmp_path}/pts").createOrReplaceTempView("pts")
    e = Engine(spark, str(tmp_path), log=True)
    p = project()
    p.canvases["low"] = Canvas("low", 2000, 2000, (Layer(Transform("SELECT * FROM pts", columns=("id", "x", "y"), base=("pts", f"{tmp_path}/pts"), reverse={"y": lambda df: df["x"] * 2}), placement=MARK, delta=False, updates=True),))
    assert len(e.load(p)) == 3 and e.load(p) == []
    assert Engine(spark, str(tmp_path)).load(p) == [], "what an earlier session built is not built again"
    whole = e.layer("top", 0)
    seen = []
    for event in ("pan", "zoom"):
        e.on(event, lambda c, event=event: seen.append((event, c)))
    for x, y in ((400, 400), (420, 400), (600, 500), (0, 0)):
        state = e.pan("top", x, y, "v")[0]
        box = e._held[("top", "v")][0]
        ids = [r["id"] for r in state.collect()]
        assert len(ids) == len(set(ids)) == viewport.in_box(whole, box).count(), "held and new rows are those of the box"
        assert "Union" not in state._jdf.queryExecution().toString(), "a state is read, not computed again"
    assert ("pan", "top") in seen and "id" in e.object_data("top", "v", 0).columns
    tile = e.tile("top", 0, 0)
    assert tile[1].num_rows == viewport.in_box(whole, Box(0, 0, 1024, 1024)).count() and e.tile("top", 0, 0) is tile
    for i in range(1, 12):
        e.tile("top", 1024 * i, 0)
    assert len(e._tiles) == 10
    one = whole.first()
    assert e.centroid("top", 0, e.predicate("top", 0, f"(id='{one['id']}')")) == (one["cx"], one["cy"])
    with pytest.raises(ValueError):
        e.centroid("top", 0, Everything())
    some = e.trigger_predicate("top", "v", {0: f"(id='{one['id']}')"})[0]
    assert some.count() <= 1 and e.trigger_pan("v", one["cx"] - 50, one["cy"] - 50)[0].count() == 1
    j = e.project.add_jump(Jump("top", "low", "semantic_zoom", predicates=lambda row: {"layer0": {"==": ["id", str(row["id"])]}}, viewport=lambda row: {"centroid": {"layer0": {"==": ["id", str(row["id"])]}}}))
    assert [r["id"] for r in e.trigger_jump(j, "v", {"id": one["id"]})[0].collect()] == [one["id"]]
    e.pan("top", 300, 300, "v")
    e.zoom("v", True)
    assert e._at["v"] == ("low", 700.0, 700.0) and ("zoom", "low") in seen
    assert e.update("low", 0, spark.createDataFrame([(one["id"], 5)], "id long, x int"), ["id"]) == 1
    assert e.layer("low", 0).where(F.col("id") == one["id"]).first()["x"] == 5 and e.layer("low", 0).count() == 3000
    base = spark.table("pts").where(F.col("id") == one["id"]).first()
    assert (base["x"], base["y"]) == (5, 10) and spark.table("pts").count() == 3000, "the base table changes too, through the reverse function"
    few, e_made = e.pan("top", 0, 0, "v")[0], len(e._made)
    assert few.count() >= 0 and e_made > 5
    e.close()
    with pytest.raises(Exception):
        few.count()
    log = spark.read.parquet(f"{tmp_path}/stats")
    assert {r["query_type"] for r in log.select("query_type").distinct().collect()} == {"pan", "jump", "tile", "update"} and log.where("fetch_time_ms <= 0").isEmpty()
    assert log.where("query_type = 'pan'").agg(F.max("rows_fetched")).first()[0] > 100


def test_views_of_jumps(spark, tmp_path):
    """Load goes to the view named, highlight marks what is held there, slide moves by a viewport, the first call gives the initial state."""
    synthetic.uniform_points(spark, 500, 1000, 1000).select("id", F.col("w").alias("x"), F.col("h").alias("y")).createOrReplaceTempView("pts")
    p = project()
    p.add_view(View("other", 300, 300, "low", 100, 200, {"layer0": {"==": ["id", "7"]}}))
    load = p.add_jump(Jump("top", "low", "load", source_view="v", dest_view="other", viewport=lambda row: {"constant": (row["x"], 0)}))
    mark = p.add_jump(Jump("top", "low", "highlight", source_view="v", dest_view="other", predicates=lambda row: {"layer0": {"==": ["id", str(row["id"])]}}))
    slide = p.add_jump(Jump("top", "low", "slide", slide_direction=0))
    e = Engine(spark, str(tmp_path))
    e.load(p)
    first = e.first("other")
    assert first["viewport"] == (100, 200) and {r["id"] for r in first["rows"][0].collect()} <= {7} and first["canvases"]["top"] == (1000, 1000)
    e.pan("top", 0, 0, "v")
    rows = e.trigger_jump(load, "v", {"x": 400})
    assert e._at["other"] == ("low", 400.0, 0.0) and e._at["v"][0] == "top"
    some = rows[0].first()
    lit = e.trigger_jump(mark, "v", {"id": some["id"]})[0]
    assert [r["id"] for r in lit.where("highlighted").collect()] == [some["id"]] and lit.count() == rows[0].count()
    e.trigger_jump(slide, "v", {})
    assert e._at["v"] == ("low", 200.0, 0.0)


def test_templates_are_built(spark, tmp_path):
    """Pyramid, table, chart and map: load, pan, static rows, jump."""
    r = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(c), "uv"[i % 2], i % 5) for i, (a, b, c) in enumerate(r.uniform(0, 100, (400, 3)))]
    spark.createDataFrame(rows, "id long, x double, y double, z double, d string, g int").createOrReplaceTempView("rows_t")
    square = lambda lon, lat, s: f'{{"type":"Polygon","coordinates":[[[{lon},{lat}],[{lon},{lat + s}],[{lon + s},{lat + s}],[{lon + s},{lat}],[{lon},{lat}]]]}}'
    spark.createDataFrame([("A", 1.0, square(-100, 38, 4)), ("B", 2.0, square(-90, 35, 3)), ("bad", 0.0, "{")], "name string, rate double, geomstr string").createOrReplaceTempView("states_t")
    spark.createDataFrame([(f"c{i}", 1.0 * i, square(-100 + i, 38, 1)) for i in range(4)], "name string, rate double, geomstr string").createOrReplaceTempView("counties_t")
    p = Project("t")
    spec = PyramidSpec("id", "x", "y", "z", (0, 100), (0, 100), levels=2, top_width=400, top_height=400, mark_w=30, mark_h=30, theta=1.0, measures=("z",))
    levels = add_pyramid(p, PyramidTemplate(spec, "SELECT * FROM rows_t", functions=("sum", "avg")))
    grid = add_table(p, TableTemplate("rows_t", ("id", "x"), "z, id", group_by=("g",)))
    plain = add_table(p, TableTemplate("rows_t", ("id", "x"), "z desc, id"))
    bars = add_chart(p, ChartTemplate("SELECT * FROM rows_t", "bar", ("d",), "COUNT(*)", sample=("id",)))
    states, counties = add_map(p, MapTemplate("states_t", "rate", "counties_t", zoom_factor=4, zoom_type="jump"))
    p.add_view(View("v", 300, 300, levels[0].id))
    e = Engine(spark, str(tmp_path), log=True)
    e.load(p)

    want = build_pyramid(spark.table("rows_t"), spec)
    for level, c in enumerate(levels):
        got = {t["id"]: t for t in e.layer(c.id, 1).collect()}
        assert set(got) == {t["id"] for t in want.levels.where(F.col("level") == level).collect()}
        assert sum(t["cluster_agg"]["count(*)"] for t in got.values()) == 400
        assert sum(t["cluster_agg"]["sum(z)"] for t in got.values()) == pytest.approx(sum(v[3] for v in rows))
        assert all(t["top"] and t["hull"] and t["d"] in "uv" for t in got.values())
    assert len(e.layer(levels[2].id, 1).collect()) > len(e.layer(levels[0].id, 1).collect())
    told = Engine(spark, str(tmp_path))
    told.project = p
    assert told.pyramid_information(levels[0].id, 1)["ranges"]["0"]["rough_n"] == e.layer(levels[0].id, 1).count()
    e.pan(levels[0].id, 50, 50, "v")
    assert e.zoom("v", True)[1].count() == viewport.in_box(e.layer(levels[1].id, 1), e._held[levels[1].id, "v"][0]).count()

    assert e.size(grid.id) == (200.0, 400 * 40 + 50) and e.size(grid.id, {0: Equals("g", "3")}) == (200.0, 80 * 40 + 50)
    one = e.layer(grid.id, 0).where("g = 3").orderBy("rn").collect()
    assert [t["rn"] for t in one] == list(range(1, 81)) and one[0]["cell_y"] == 70.0 and one[0]["id"] == min((v[3], v[0]) for v in rows if v[5] == 3)[1]
    e._predicates[grid.id, "v"] = {0: e.predicate(grid.id, 0, "(g='3')")}
    assert {t["g"] for t in e.pan(grid.id, 0, 0, "v")[0].collect()} == {3}
    assert sorted(t["rn"] for t in e.pan(plain.id, 0, 0, "v")[0].collect())[:3] == [1, 2, 3]
    with pytest.raises(ValueError):
        e.size(grid.id, {0: Equals("x", "1")})

    size, chart = e.canvas(bars.id, {0: Equals("d", "u")})
    assert size == (1000.0, 1000.0) and [(t["d"], t["agg_value"]) for t in chart[0].collect()] == [("u", 200)] and [t["id"] for t in chart[1].collect()] == list(range(75))
    with pytest.raises(ValueError):
        e.static_layer(bars.id, 0, Equals("x", "1"))

    at = {t["name"]: t for t in e.layer(states.id, 1).collect()}
    assert 0 < at["A"]["cx"] < at["B"]["cx"] < 2000 and (at["bad"]["cx"], at["bad"]["cy"]) == (0, 0)
    j = p.jumps[-1]
    assert navigation.applicable(p, states.id, {}, {"layer": 1}) == [j] and not navigation.applicable(p, states.id, {}, {"layer": 0})
    seen = e.trigger_jump(j, "v", at["A"].asDict())
    assert e._at["v"] == (counties.id, at["A"]["cx"] * 4 - 1000, at["A"]["cy"] * 4 - 500)
    assert set(seen) == {1, 2} and {t["name"] for t in e.layer(counties.id, 2).collect()} == {"c0", "c1", "c2", "c3"}
    for t in e.layer(counties.id, 1).where("name <> 'bad'").collect():
        assert (t["cx"] / 4, t["cy"] / 4) == (pytest.approx(at[t["name"]]["cx"]), pytest.approx(at[t["name"]]["cy"]))


def test_fingerprints():
    """Whatever a transform's function reads changes the fingerprint: names it calls, captured values, constants, globals, nested functions."""

    def of(function, query="q"):
        return stale_layers(None, (p := make(function, query))) and fingerprint(p.canvases["c"], 0, p.params)

    def make(function, query):
        p = Project("p")
        p.add_canvas(Canvas("c", 10, 10, (Layer(Transform(query, function=function, columns=("x", "y")), placement=MARK),)))
        return p

    def captured(n):
        return lambda df: df.where(F.col("x") > n)

    pairs = [
        (lambda df: df.agg(F.min("x")), lambda df: df.agg(F.max("x"))),
        (captured(1), captured(2)),
        (lambda df: df.limit(1), lambda df: df.limit(2)),
        (lambda df: [F.col(c) for c in ("a",)], lambda df: [F.col(c) for c in ("b",)]),
        (lambda df, k=1: df, lambda df, k=2: df),
    ]
    for a, b in pairs:
        assert of(a) != of(b)
    assert of(captured(1)) == of(captured(1)) and of(captured(1), "q") != of(captured(1), "r")


@pytest.mark.parametrize("lon,lat,x,y", [(-122.4194, 37.7749, 107.4, 214.1), (-74.0059, 40.7128, 794.6, 176.5), (-95.9928, 36.1540, 488.8, 298.0), (-149.9003, 61.2181, 171.2, 446.9), (-157.8583, 21.3069, 298.5, 451.0)])
def test_composite_projection(lon, lat, x, y):
    """Published sample positions of the public composite projection at its default scale."""
    px, py = geo.albers_usa(np.array([lon]), np.array([lat]))
    assert px[0] == pytest.approx(x, abs=0.1) and py[0] == pytest.approx(y, abs=0.1)
    assert np.isnan(geo.albers_usa(np.array([2.35]), np.array([48.86]))[0][0])


def test_documents_and_csv(spark, tmp_path):
    path = str(tmp_path / "docs")
    sinks.save_document(spark, path, "p", {"a": 1})
    sinks.save_document(spark, path, "p", {"a": 2})
    assert sinks.load_document(spark, path, "p") == {"a": 2} and sinks.load_document(spark, path, "q") is None
    (tmp_path / "my-file.csv").write_text('a;b\n1;"x;y"\n2;\n')
    df = readers.load_csv(spark, str(tmp_path / "my-file.csv"), sep=";")
    assert [tuple(r) for r in spark.table("my_file").collect()] == [("1", "x;y"), ("2", None)] and df.columns == ["a", "b"]
    assert list(readers.rows_as_text(df)) == [["1", "x;y"], ["2", ""]]


def test_computed_transform(spark):
    spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double").createOrReplaceTempView("raw_t")
    t = computed("raw_t", {"id": "id", "x": "coalesce(v, 0) * 10"}, filterable=("id",))
    assert t.columns == ("id", "x") and sorted(map(tuple, t.rows(spark).collect())) == [(1, 20.0), (2, 0.0)]
    assert computed("SELECT id FROM raw_t WHERE id > 1;", {"y": "id + 1"}).rows(spark).collect() == [(3,)]
    assert ChartTemplate("q", "bar", ("a",), "SUM(b)").tooltip == ("a", "agg_value") and ChartTemplate("q", "bar", ("a",), "SUM(b)").aliases == ("a", "SUM(b)")


def test_updates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0)], "k int, s string, v double")
    ch = spark.createDataFrame([(2, None, "z"), (2, None, "z"), (9, "q", "z")], "k int, s string, other string")
    assert sorted((r["k"], r["s"] or "") for r in mutations.update_rows(df, ch, ["k"]).collect()) == [(1, "a"), (2, ""), (2, "")]
    assert mutations.changed_columns(["s", "no"], df) == ["s"]
    assert mutations.remove_rows(df, ch, ["k"]).count() == 1


def test_synthetic(spark):
    t = synthetic.skewed_points(spark, 5000)
    share = t.where("w < 40000 and h < 50000").count() / 5000
    assert 0.78 < share < 0.9 and synthetic.series(spark, 3, 7).count() == 5


def test_stream(spark, tmp_path):
    from zoomloom.streaming import fetch_log

    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 01:10:00", "a", 2.0)], "id long, t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = fetch_log.windowed(fetch_log.first_of_id(s, "id", "t"), "t", ["k"], "v", late=None).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["total"] for r in spark.table("w").collect()) == [1.0, 2.0]
