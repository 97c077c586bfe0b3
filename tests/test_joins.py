"""Pairs by key, spatial join, components: against brute force on small tables, with hot keys and dirt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoomloom.operators.balance import pack_pairs, pack_units, pair_slots
from zoomloom.operators.components import connected_components, union_labels
from zoomloom.operators.skew_pairs import near_pairs_by_key
from zoomloom.operators.spatial_join import PackedRTree, Quadtree, clean_boxes, near_and_inside

DOT = "key int, id int, w int, h int, extra string"


def brute_pairs(rows, reach=2, extent=(0, 0, 1000, 1000)):
    ok = {r[:4] for r in rows if None not in r[:4] and extent[0] <= r[2] <= extent[2] and extent[1] <= r[3] <= extent[3]}
    return {(a[0], a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= reach and abs(a[3] - b[3]) <= reach}


@pytest.mark.parametrize("tasks", [1, 7, 16])
def test_pairs_with_hot_key(spark, tasks):
    rng = random.Random(tasks)
    rows = []
    for i in range(1500):
        key = 1 if i % 3 else rng.choice([2, 3, 4, 5, 6, None])
        spot = i % 5 == 0  # a third of the hot key in one place
        rows.append((key, i, 500 + rng.randint(0, 20) if spot else rng.randint(-5, 1005), 500 + rng.randint(0, 20) if spot else rng.randint(-5, 1005), "x"))
    rows += rows[::9]
    rows += [(1, 9000, None, 5, None), (1, None, 5, 5, None)]
    df = spark.createDataFrame(rows, DOT)
    got = near_pairs_by_key(df, "key", "id", "w", "h", 2, 2, (0, 0, 1000, 1000), tasks=tasks).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute_pairs(rows)


def test_pairs_edges(spark):
    empty = spark.createDataFrame([], DOT)
    assert near_pairs_by_key(empty, "key", "id", "w", "h", 2, 2, (0, 0, 9, 9)).count() == 0
    same = spark.createDataFrame([("k", "a", 1, 1), ("k", "b", 1, 1), ("k", "a", 1, 1), ("q", "c", 1, 1)], "bin string, slot string, x int, home int")  # names the operator uses itself
    got = near_pairs_by_key(same, "bin", "slot", "x", "home", 0, 0, (0, 0, 9, 9)).collect()
    assert [tuple(r) for r in got] == [("k", "a", "b")]


def test_far_extent_does_not_overflow(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 0.5, 0.5), (1, 3, 9e11, 9e11), (1, 4, 9e11 + 1, 9e11)]
    df = spark.createDataFrame(rows, "key int, id int, x double, y double")
    got = near_pairs_by_key(df, "key", "id", "x", "y", 1, 1, (0, 0, 1e12, 1e12)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2), (1, 3, 4)}


def gap(a, b):
    dx, dy = max(0, a[1] - b[3], b[1] - a[3]), max(0, a[2] - b[4], b[2] - a[4])
    return dx * dx + dy * dy


@pytest.mark.parametrize("tasks", [1, 5, 16])
def test_spatial_join(spark, tasks):
    rng = random.Random(tasks)
    boxes = []
    for i in range(600):
        x, y = (rng.uniform(0, 30), rng.uniform(0, 30)) if i % 3 == 0 else (rng.uniform(0, 3000), rng.uniform(0, 3000))
        x, y = round(x * 8) / 8, round(y * 8) / 8
        w = rng.choice([1, 1, 1, 60])
        c = (x, y, x + w, y + w)
        boxes.append((i, *(c if i % 7 else (c[2], c[3], c[0], c[1]))))
    boxes += boxes[::5]
    dirt = [(9001, None, 1.0, 2.0, 2.0), (9002, float("nan"), 1.0, 2.0, 2.0), (None, 1.0, 1.0, 2.0, 2.0)]
    views = [(1, 0.0, 0.0, 40.0, 40.0), (2, 3000.0, 3000.0, -10.0, -10.0), (3, None, 0.0, 1.0, 1.0), (1, 0.0, 0.0, 40.0, 40.0)]
    cols = "i long, minx double, miny double, maxx double, maxy double"
    a, v = spark.createDataFrame(boxes + dirt, cols), spark.createDataFrame(views, cols)
    got = [tuple(r) for r in near_and_inside(clean_boxes(a, "i"), clean_boxes(v, "i"), 2.0, tasks=tasks).collect()]
    fix = lambda r: (r[0], min(r[1], r[3]), min(r[2], r[4]), max(r[1], r[3]), max(r[2], r[4]))
    b = sorted({fix(r) for r in boxes})
    want = {("near", p[0], q[0]) for p in b for q in b if p[0] < q[0] and gap(p, q) <= 4}
    want |= {("inside", u[0], p[0]) for u in {fix(r) for r in views if None not in r} for p in b if p[1] >= u[1] and p[2] >= u[2] and p[3] <= u[3] and p[4] <= u[4]}
    assert len(got) == len(set(got))
    assert set(got) == want


def test_spatial_join_empty(spark):
    e = clean_boxes(spark.createDataFrame([], "i long, minx double, miny double, maxx double, maxy double"), "i")
    assert near_and_inside(e, e, 2.0).count() == 0
    assert near_and_inside(e, None, 2.0).count() == 0


def test_rtree_and_quadtree():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 100, 500), rng.uniform(0, 100, 500)
    tree = PackedRTree(x, y, x + 2, y + 2)
    hits = {(int(a), int(b)) for p, q in tree.probe(x[:50], y[:50], x[:50] + 5, y[:50] + 5) for a, b in zip(p, q)}
    assert hits == {(i, j) for i in range(50) for j in range(500) if x[j] <= x[i] + 5 and x[j] + 2 >= x[i] and y[j] <= y[i] + 5 and y[j] + 2 >= y[i]}
    quad = Quadtree(x, y, 20, 0.5)
    row, leaf = quad.leaves(x, y, x, y)
    assert sorted(row) == list(range(500)), "a point lies in one leaf"
    b = quad.bounds[leaf]
    assert ((x[row] >= b[:, 0]) & (x[row] < b[:, 2]) & (y[row] >= b[:, 1]) & (y[row] < b[:, 3])).all()


def test_packing_of_units():
    bins = pack_units([100, 1, 1, 1, 50, 0], 4)
    assert len(bins) == 6 and bins.max() < 4 and np.bincount(bins, weights=[100, 1, 1, 1, 50, 1]).max() == 100


@pytest.mark.parametrize("shards", [1, 2, 5, 11])
def test_pairs_of_shards_meet_once(shards):
    own = np.arange(40) % shards
    row, slot, cross = pair_slots(own, np.full(40, shards))
    met = {}
    for s in range(shards * (shards + 1) // 2):
        at = np.flatnonzero(slot == s)
        assert len(set(own[row[at]])) <= 2, "a slot sees two shards at most"
        for i in at:
            for j in at:
                if row[i] < row[j] and (cross[i] < 0 or cross[i] != cross[j]):
                    met[row[i], row[j]] = met.get((row[i], row[j]), 0) + 1
    assert met == {(i, j): 1 for j in range(40) for i in range(j)}


def test_one_crowded_tile_over_64_tasks():
    """A tile of a million rows that all meet: no slot has more than two shards, no task twice the mean, and rows are copied once a shard."""
    n = 1_000_000
    shards, first, bins = pack_pairs([float(n) * n, *[1000.0] * 50], [n, *[1000] * 50], 64, 800_000)
    rows = np.bincount(np.random.default_rng(0).integers(0, shards[0], n), minlength=shards[0])
    slots = shards[0] * (shards[0] + 1) // 2
    assert 10 <= shards[0] <= 12 and slots <= 64 and np.bincount(bins[:slots], minlength=64).max() == 1
    assert 2 * rows.max() < n / 4 and list(shards[1:]) == [1] * 50


def test_crowded_spot_of_a_key(spark):
    """Half of a key's records at one spot, and another key that lies only there: every pair once, whatever the shards."""
    rng = random.Random(9)
    rows = [(1, i, 50, 50) if i % 2 else (1, i, rng.randint(0, 1000), rng.randint(0, 1000)) for i in range(600)] + [(2, i, 7, 7) for i in range(120)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOT)
    got = [tuple(r) for r in near_pairs_by_key(df, "key", "id", "w", "h", 2, 2, (0, 0, 1000, 1000), tasks=9).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


@pytest.mark.parametrize("edges_per_task", [10_000, 12])
def test_components(spark, edges_per_task):
    rng = random.Random(5)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, edges_per_task).collect()}
    good = [(a, b) for a, b in edges if a is not None]
    label = union_labels(300, np.array([a for a, _ in good]), np.array([b for _, b in good]))
    assert got == {n: int(label[n]) for e in good for n in e}


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_p1_registered_over_whole_table(spark):
    from zoomloom.plans.corpus import p1_found

    df = p1_found(spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("citus_distribution_id", "int"), ("id_a", "int"), ("id_b", "int")]
    assert df.where(F.col("id_a") >= F.col("id_b")).count() == 0
