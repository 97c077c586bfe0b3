"""Cluster pyramids of scatterplots: non-overlapping heads per zoom level, with mergeable aggregates.

A level's heads are the greedy choice in rank order: a point becomes a head unless an earlier head lies within theta (normalised
Chebyshev distance); all others join their nearest earlier head. Cells of side theta hold one head at most, so only the first few open points
of a cell can matter next. A round sends these, tile by tile with the cells around, through the sequential choice; what depends on points the
tile does not see stays open, points near a new head are settled, and the next round goes on with the rest on tiles laid otherwise. The first
open point of all is always decided, so the rounds end; the result equals the sequential one exactly, at any number of tiles.

The rows themselves are aggregated once, at the bottom. All levels above merge the aggregates, top lists and hulls of the one below.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoomloom.functions.hull import hull_points
from zoomloom.operators.placement import canvas_position
from zoomloom.session import discard, materialize

PREFIX = 8  # open points of a cell that a round looks at
TILE_ROWS = 100_000
TILE_SIDE = 256  # cells; with PREFIX the bound of a tile however crowded it is
MODES = ("custom", "circle", "contour", "heatmap", "radar", "pie", "dot")
FUNCTIONS = ("count", "sum", "avg", "min", "max", "sqrsum")


def overlap_threshold(w: int, h: int, overlap: float = 1.0, least: float = 0.2, distributed: bool = False) -> float:
    """The density bound of at most 4000 marks a 1000 x 1000 region, in whole-number arithmetic, and the spec's overlap."""
    dense = math.sqrt(4 * (1000 + 2 * w) * (1000 + 2 * h) // 4000 // h // w)
    return max(max(least, dense - (0 if distributed else 1)), overlap)


def mark_size(mode: str, size: float = 0.0, config: tuple[int, int] | None = None) -> tuple[int, int]:
    """Width and height of a mark: given for custom ones, else by mode (size is its greatest radius)."""
    if mode == "custom":
        if not config:
            raise ValueError("custom marks need a size")
        return config
    side = {"circle": 2 * size, "contour": 2 * size, "heatmap": 2 * size + 1, "radar": 290, "pie": 290, "dot": math.floor(2.5 * size)}
    if mode not in side:
        raise ValueError(f"unknown mode {mode!r}")
    return int(side[mode]), int(side[mode])


@dataclass(frozen=True)
class PyramidSpec:
    """x, y: columns and their extents; z: importance, ties by id. measures: column -> functions; dimensions: columns of the categories."""

    id: str
    x: str
    y: str
    z: str
    extent_x: tuple[float, float]
    extent_y: tuple[float, float]
    levels: int = 4
    top_width: int = 1000
    top_height: int = 1000
    mark_w: int = 100
    mark_h: int = 100
    zoom: float = 2.0
    ascending: bool = False
    overlap: float | None = None
    theta: float | None = None
    topk: int = 3
    measures: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = field(default=())
    mode: str = "custom"

    def __post_init__(self):
        if not 1 <= self.levels <= 50 or not 1.1 <= self.zoom <= 5 or not 0 <= self.allowed_overlap <= 1 or not 1 <= self.topk <= 8:
            raise ValueError("levels 1..50, zoom 1.1..5, overlap 0..1, topk 1..8")
        if self.extent_x[0] == self.extent_x[1] or self.extent_y[0] == self.extent_y[1]:
            raise ValueError("the extent of a pyramid axis is empty")

    @property
    def allowed_overlap(self) -> float:
        """As given, else none for contours and heat maps and full marks apart for the rest."""
        return self.overlap if self.overlap is not None else 0.0 if self.mode in ("contour", "heatmap") else 1.0

    @property
    def distance(self) -> float:
        return self.theta if self.theta is not None else overlap_threshold(self.mark_w, self.mark_h, self.allowed_overlap)


def extents(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least and greatest x and y, of negative data too."""
    return df.agg(F.min(x).alias("lo_x"), F.max(x).alias("hi_x"), F.min(y).alias("lo_y"), F.max(y).alias("hi_y"))


def init_points(df: DataFrame, spec: PyramidSpec) -> DataFrame:
    """(id, z, x, y, bx, by) of the bottom level: canvas positions there; rows with a null id or a null or NaN coordinate are left out."""
    zx = canvas_position(F.col(spec.x), *spec.extent_x, spec.top_width, spec.mark_w, spec.zoom, spec.levels)
    zy = canvas_position(F.col(spec.y), *spec.extent_y, spec.top_height, spec.mark_h, spec.zoom, spec.levels)
    ok = df.where(F.col(spec.id).isNotNull() & F.col(spec.x).isNotNull() & F.col(spec.y).isNotNull() & ~F.isnan(F.col(spec.x).cast("double")) & ~F.isnan(F.col(spec.y).cast("double")))
    sign = F.col(spec.z).cast("double") if spec.ascending else -F.col(spec.z).cast("double")
    return ok.select(F.col(spec.id).cast("long").alias("id"), F.coalesce(sign, F.lit(float("inf"))).alias("z"), zx.alias("x"), zy.alias("y"))


def greedy_sequence(z, ids, x, y, wide: float, tall: float, fixed=None) -> np.ndarray:
    """Sequential choice in order (z, id): boolean array of heads. fixed: (x, y) of heads that stand already."""
    cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
    if fixed is not None:
        for hx, hy in zip(*fixed):
            cells.setdefault((int(hx // wide), int(hy // tall)), []).append((hx, hy))
    head = np.zeros(len(x), dtype=bool)
    for i in np.lexsort((ids, z)):
        a, b = float(x[i]), float(y[i])
        cx, cy = int(a // wide), int(b // tall)
        if not any(abs(a - p) <= wide and abs(b - q) <= tall for u in (cx - 1, cx, cx + 1) for v in (cy - 1, cy, cy + 1) for p, q in cells.get((u, v), ())):
            head[i] = True
            cells.setdefault((cx, cy), []).append((a, b))
    return head


def _cells(x: Column, y: Column, wide: float, tall: float) -> dict[str, Column]:
    return {"u": F.floor(x / wide), "v": F.floor(y / tall)}


def _spread(df: DataFrame) -> DataFrame:
    """Each row at its own and the eight cells around."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("t", F.explode(near)).withColumns({"u": F.col("u") + F.col("t.a"), "v": F.col("v") + F.col("t.b")}).drop("t")


def settle_tile(z, ids, x, y, u, v, place, home, wide: float, tall: float, prefix: int) -> tuple[list[int], list[int]]:
    """(heads, undecided): rows of a tile's own cells, from the open points of the tile and of the cells around it.

    place is a point's number in its cell; a point numbered prefix + 1 stands for all that follow, which are not there. A point is
    undecided if an earlier undecided one lies within theta, or if a cell around has unseen earlier points and no head.
    """
    heads: dict[tuple[int, int], list[tuple[float, float]]] = {}
    waits: dict[tuple[int, int], list[tuple[float, float]]] = {}
    unseen: set[tuple[int, int]] = set()
    out, left = [], []
    order = np.lexsort((ids, z)).tolist()
    us, vs, xs, ys, own, more = (c.tolist() for c in (u, v, x, y, home, place > prefix))
    for i in order:
        c, a, b = (us[i], vs[i]), xs[i], ys[i]
        if c in heads:
            continue
        around = [(c[0] + p, c[1] + q) for p in (-1, 0, 1) for q in (-1, 0, 1)]
        if any(abs(a - p) <= wide and abs(b - q) <= tall for n in around for p, q in heads.get(n, ())):
            if more[i]:
                unseen.add(c)
                if own[i]:
                    left.append(i)
            continue
        if more[i]:
            unseen.add(c)
        elif own[i] and not any(n in unseen for n in around) and not any(abs(a - p) <= wide and abs(b - q) <= tall for n in around for p, q in waits.get(n, ())):
            heads.setdefault(c, []).append((a, b))
            out.append(i)
            continue
        waits.setdefault(c, []).append((a, b))
        if own[i]:
            left.append(i)
    return out, left


def choose_heads(points: DataFrame, wide: float, tall: float, prefix: int = PREFIX, tile_rows: int = TILE_ROWS, tile_side: int = TILE_SIDE) -> DataFrame:
    """Heads (id, z, x, y) of points (id, z, x, y); wide and tall are theta in canvas units. Ids are unique."""
    columns = "id long, z double, x double, y double"
    open_ = points.select("id", "z", "x", "y").withColumns(_cells(F.col("x"), F.col("y"), wide, tall))
    before: DataFrame | None = None
    heads: DataFrame | None = None
    turn, made_in_rounds = 0, []
    while True:
        told = open_.agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.max("u").alias("u1"), F.min("v").alias("v"), F.max("v").alias("v1")).first()
        tiles = max(1, math.ceil(told["n"] / tile_rows))
        wide_u, wide_v = ((told["u1"] or 0) - (told["u"] or 0) + 1), ((told["v1"] or 0) - (told["v"] or 0) + 1)
        side = max(4, min(tile_side, math.ceil(math.sqrt(wide_u * wide_v / tiles)))) if tiles > 1 else max(4, min(tile_side, max(wide_u, wide_v)))
        shift = (turn % 2) * (side // 2)
        first = open_.withColumn("place", F.row_number().over(W.partitionBy("u", "v").orderBy("z", "id"))).where(F.col("place") <= prefix + 1)
        spot = lambda c, low, d: F.floor((F.col(c) - F.lit(low or 0) + shift + d) / side)
        near = F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(spot("u", told["u"], a).alias("tu"), spot("v", told["v"], b).alias("tv")) for a in (-1, 0, 1)]) for b in (-1, 0, 1)])))
        home = (F.col("t.tu") == spot("u", told["u"], 0)) & (F.col("t.tv") == spot("v", told["v"], 0))
        routed = first.withColumn("t", F.explode(near)).select("id", "z", "x", "y", "u", "v", "place", home.alias("home"), "t.tu", "t.tv")

        def settle(batches):
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            c = {k: t[k].to_numpy(zero_copy_only=False) for k in t.column_names}
            order = np.lexsort((c["tv"], c["tu"]))
            cuts = np.flatnonzero((np.diff(c["tu"][order]) != 0) | (np.diff(c["tv"][order]) != 0)) + 1
            rows, is_head = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(order)]):
                at = order[lo:hi]
                new, left = settle_tile(*(c[k][at] for k in ("z", "id", "x", "y", "u", "v", "place", "home")), wide, tall, prefix)
                rows += [at[new], at[left]]
                is_head += [np.ones(len(new), bool), np.zeros(len(left), bool)]
            out = t.select(["id", "z", "x", "y"]).take(pa.array(np.concatenate(rows)))
            yield from out.append_column("head", pa.array(np.concatenate(is_head))).to_batches(max_chunksize=10_000)

        made = materialize(routed.repartition(tiles, "tu", "tv").mapInArrow(settle, columns + ", head boolean"))
        made_in_rounds.append(made)
        new = made.where("head").drop("head")
        heads = new if heads is None else heads.unionByName(new)
        if made.where(~F.col("head")).isEmpty():
            if before is not None:
                discard(before)
            heads._tables = made_in_rounds
            return heads
        h = _spread(new.withColumns(_cells(F.col("x"), F.col("y"), wide, tall))).select("u", "v", F.col("x").alias("hx"), F.col("y").alias("hy"))
        hit = (open_["u"] == h["u"]) & (open_["v"] == h["v"]) & (F.abs(open_["x"] - h["hx"]) <= wide) & (F.abs(open_["y"] - h["hy"]) <= tall)
        now = materialize(open_.join(h, hit, "left_anti"))
        if before is not None:
            discard(before)
        open_, before, turn = now, now, turn + 1


def join_heads(points: DataFrame, heads: DataFrame, wide: float, tall: float) -> DataFrame:
    """(id, head): the nearest earlier head within theta, ties to the earlier; heads join themselves."""
    h = _spread(heads.withColumns(_cells(F.col("x"), F.col("y"), wide, tall))).select("u", "v", F.col("id").alias("head"), F.col("z").alias("hz"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    p = points.withColumns(_cells(F.col("x"), F.col("y"), wide, tall))
    far = F.greatest(F.abs(F.col("x") - F.col("hx")) / wide, F.abs(F.col("y") - F.col("hy")) / tall)
    earlier = (F.col("hz") < F.col("z")) | ((F.col("hz") == F.col("z")) & (F.col("head") <= F.col("id")))
    near = p.join(h, ["u", "v"]).where(earlier & (F.abs(F.col("x") - F.col("hx")) <= wide) & (F.abs(F.col("y") - F.col("hy")) <= tall))
    return near.groupBy("id").agg(F.min(F.struct(far.alias("d"), F.col("hz"), F.col("head"))).alias("m")).select("id", F.col("m.head").alias("head"))


class Pyramid:
    """The heads of all levels; aggregates, top lists, hulls and members by level and head are made when they are asked for.

    The rows are aggregated once, by head of the bottom level; every level above merges these partial results along `lifts`.
    """

    def __init__(self, base: DataFrame, spec: PyramidSpec, heads: dict[int, DataFrame], steps: dict[int, DataFrame], points: DataFrame):
        self.spec, self._base, self._heads, self._steps = spec, base, heads, steps
        self._tables = [points, *steps.values(), *[t for h in heads.values() for t in h._tables]]
        self._wide, self._tall = spec.distance * spec.mark_w, spec.distance * spec.mark_h

    @property
    def levels(self) -> DataFrame:
        """(level, id, x, y, minx, miny, maxx, maxy) of the heads."""
        w, h = self._wide / 2, self._tall / 2
        return _union([t.select(F.lit(n).alias("level"), "id", "x", "y", (F.col("x") - w).alias("minx"), (F.col("y") - h).alias("miny"), (F.col("x") + w).alias("maxx"), (F.col("y") + h).alias("maxy")) for n, t in self._heads.items()])

    @functools.cached_property
    def lifts(self) -> DataFrame:
        """(bottom, level, head): the head on every level of each head of the bottom."""
        bottom = self._heads[self.spec.levels]
        chain = bottom.select(F.col("id").alias("bottom"), F.col("id").alias("head"))
        out = [chain.select("bottom", F.lit(self.spec.levels).alias("level"), "head")]
        for level in range(self.spec.levels - 1, -1, -1):
            chain = materialize(chain.join(self._steps[level].toDF("head", "up"), "head").select("bottom", F.col("up").alias("head")))
            self._tables.append(chain)
            out.append(chain.select("bottom", F.lit(level).alias("level"), "head"))
        return _union(out)

    def release(self) -> None:
        """Delete the tables of the build, when all that is wanted of it has been written elsewhere."""
        discard(*self._tables)

    @property
    def members(self) -> DataFrame:
        """(level, id, head) of every row."""
        return self._steps[self.spec.levels].toDF("id", "bottom").join(self.lifts, "bottom").select("level", "id", "head")

    @property
    def _rows(self) -> DataFrame:
        """The rows with the head of the bottom level that they belong to."""
        named = self._base.withColumn("__id", F.col(self.spec.id).cast("long"))
        return named.join(self._steps[self.spec.levels].toDF("__id", "bottom"), "__id")

    @property
    def aggregates(self) -> DataFrame:
        measures, dimensions = list(self.spec.measures), list(self.spec.dimensions)
        own = cluster_aggregates(self._rows, ["bottom", *dimensions], measures, self.spec.x, self.spec.y)
        return merge_aggregates(own.join(self.lifts, "bottom"), ["level", "head", *dimensions], measures)

    @property
    def top(self) -> DataFrame:
        """(level, head, place, id): the first spec.topk members by importance; those of merged clusters are among those of each."""
        own = _first(self._rows.select("bottom", F.col("__id").alias("id"), F.col(self.spec.z).alias("z")), ["bottom"], self.spec)
        return _first(own.join(self.lifts, "bottom"), ["level", "head"], self.spec).select("level", "head", "place", "id")

    @property
    def hulls(self) -> DataFrame:
        """(level, head, hull) over the members' raw positions."""
        own = cluster_hulls(self._rows, "bottom", self.spec.x, self.spec.y)
        return merge_hulls(own.join(self.lifts, "bottom"), ["level", "head"]).select("level", "head", F.arrays_zip(F.col("hx").alias("x"), F.col("hy").alias("y")).alias("hull"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def build_pyramid(df: DataFrame, spec: PyramidSpec) -> Pyramid:
    """Heads of all levels from the bottom (spec.levels) to the top (0); the points of a level are the heads of the one below. Ids are unique."""
    used = [c for c in dict.fromkeys([spec.x, spec.y, spec.z, *spec.measures, *spec.dimensions]) if c != spec.id]
    if {"level", "head", "bottom"} & {c.lower() for c in [*used, spec.id]}:
        raise ValueError("level, head and bottom are columns of the result")
    base = df.select(spec.id, *used)
    wide, tall = spec.distance * spec.mark_w, spec.distance * spec.mark_h
    own = points = materialize(init_points(base, spec))
    heads, steps = {}, {}
    for level in range(spec.levels, -1, -1):
        heads[level] = choose_heads(own, wide, tall)
        steps[level] = materialize(join_heads(own, heads[level], wide, tall))
        own = heads[level].select("id", "z", (F.col("x") / spec.zoom).alias("x"), (F.col("y") / spec.zoom).alias("y"))
    return Pyramid(base, spec, heads, steps, points)


def cluster_aggregates(rows: DataFrame, keys: list[str], measures: list[str], x: str, y: str) -> DataFrame:
    """Per keys: n, the sums of the raw positions and their squares and, of each measure, count, sum, square sum, least and greatest; averages
    are sum / count. All parts merge by addition or extremes, so partial aggregates of any split agree with the whole."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    parts = [F.count(F.lit(1)).alias("n"), F.sum(a).alias("sum_x"), F.sum(b).alias("sum_y"), F.sum(a * a + b * b).alias("xysqrsum")]
    for m in measures:
        v = F.col(m).cast("double")
        parts += [F.count(v).alias(f"cnt_{m}"), F.sum(v).alias(f"sum_{m}"), F.sum(v * v).alias(f"sqrsum_{m}"), F.min(v).alias(f"min_{m}"), F.max(v).alias(f"max_{m}"), (F.sum(v) / F.nullif(F.count(v), F.lit(0))).alias(f"avg_{m}")]
    return rows.groupBy(*keys).agg(*parts)


def merge_aggregates(parts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Merge partial aggregates of the same keys."""
    out = [F.sum(c).alias(c) for c in ("n", "sum_x", "sum_y", "xysqrsum")]
    for m in measures:
        out += [F.sum(f"cnt_{m}").alias(f"cnt_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"), F.sum(f"sqrsum_{m}").alias(f"sqrsum_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}"), (F.sum(f"sum_{m}") / F.nullif(F.sum(f"cnt_{m}"), F.lit(0))).alias(f"avg_{m}")]
    return parts.groupBy(*keys).agg(*out)


def _first(rows: DataFrame, keys: list[str], spec: PyramidSpec) -> DataFrame:
    """(keys..., place, id, z): the first spec.topk rows by importance. Spark cuts each partition down before the shuffle."""
    z = F.asc_nulls_last("z") if spec.ascending else F.desc_nulls_last("z")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(z, F.asc("id")))
    return rows.select(*keys, "id", "z").withColumn("place", place).where(F.col("place") <= spec.topk).select(*keys, "place", "id", "z")


def _hull_batch(keys: list[pa.Array], hulls: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    off = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hulls])]).astype(np.int32))
    flat = np.concatenate(hulls) if hulls else np.zeros((0, 2))
    return pa.RecordBatch.from_arrays([*keys, *[pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(flat[:, i]))) for i in (0, 1)]], names=[*names, "hx", "hy"])


def cluster_hulls(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, hx, hy): convex hulls of the members' raw positions. Tasks send one hull a cluster, so a cluster of any size is small."""

    def build(batches):
        held: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            k, xy = b.column(0).to_numpy(), np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
            order = np.argsort(k, kind="stable")
            cuts = np.flatnonzero(np.diff(k[order])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(order)]):
                i = int(k[order[lo]])
                old = held.get(i)
                own = xy[order[lo:hi]]
                held[i] = hull_points(own if old is None else np.concatenate([old, own]))
                size += len(held[i]) - (0 if old is None else len(old))
            if size > 500_000:
                yield _hull_batch([pa.array(list(held), pa.int64())], list(held.values()), [key])
                held, size = {}, 0
        if held:
            yield _hull_batch([pa.array(list(held), pa.int64())], list(held.values()), [key])

    return merge_hulls(rows.select(key, F.col(x).cast("double"), F.col(y).cast("double")).mapInArrow(build, f"{key} long, hx array<double>, hy array<double>"), [key])


def merge_hulls(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Hulls of hulls, by keys."""
    schema = T.StructType([*[parts.schema[k] for k in keys], parts.schema["hx"], parts.schema["hy"]])

    def join(batches):
        for b in batches:
            xs, ys = b.column(len(keys)), b.column(len(keys) + 1)
            x, y, off = xs.values.to_numpy(), ys.values.to_numpy(), xs.offsets.to_numpy()
            yield _hull_batch(list(b.columns[: len(keys)]), [hull_points(np.stack([x[i:j], y[i:j]], axis=1)) for i, j in zip(off, off[1:])], keys)

    return parts.groupBy(*keys).agg(F.flatten(F.collect_list("hx")).alias("hx"), F.flatten(F.collect_list("hy")).alias("hy")).mapInArrow(join, schema)


def measure_ranges(aggregates: DataFrame, measures: list[str]) -> DataFrame:
    """Per level: number of clusters, and least and greatest n and sum of each measure over its clusters."""
    out = [F.count(F.lit(1)).alias("rough_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n")]
    for m in measures:
        out += [F.min(f"sum_{m}").alias(f"min_sum_{m}"), F.max(f"sum_{m}").alias(f"max_sum_{m}")]
    return aggregates.groupBy("level").agg(*out)


def cluster_keys(aggregates: DataFrame, dimensions: list[str], measures: list[str], functions: list[str]) -> DataFrame:
    """(level, head, cluster_agg): the wire map with keys dim1__dim2__func(field), rendered at the edge only."""
    prefix = F.concat_ws("__", *[F.col(d).cast("string") for d in dimensions], F.lit("")) if dimensions else F.lit("")
    pairs = [F.struct(F.concat(prefix, F.lit("count(*)")).alias("k"), F.col("n").cast("double").alias("v"))]
    for m in measures:
        for f in functions:
            pairs.append(F.struct(F.concat(prefix, F.lit(f"{f}({m})")).alias("k"), F.col(f"{'cnt' if f == 'count' else f}_{m}").cast("double").alias("v")))
    one = aggregates.select("level", "head", F.explode(F.array(*pairs)).alias("e"))
    return one.groupBy("level", "head").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("cluster_agg"))


def merge_maps(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Aggregate maps of the same keys merged: counts and sums add up, least and greatest are kept; averages are merged as sums and counts elsewhere."""
    each = df.select(*keys, F.explode(column).alias("__k", "__v")).where(~F.col("__k").rlike(r"(^|__)avg\("))
    total = F.when(F.first("__k").rlike(r"(^|__)min\("), F.min("__v")).when(F.first("__k").rlike(r"(^|__)max\("), F.max("__v")).otherwise(F.sum("__v"))
    merged = each.groupBy(*keys, "__k").agg(total.alias("__v"))
    return merged.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__k", "__v")))).alias(column))


def merge_along_splits(heads: DataFrame, splits: list[float], wide: float, tall: float) -> DataFrame:
    """The approximate border merge: per split, in y order, a head conflicting (distance < theta) with the last kept one gives way
    to the more important. Input (id, z, x, y) of heads chosen per leaf; returns the heads that stay. Offered for comparison; choose_heads is exact."""
    near = F.lit(None).cast("int")
    for i, s in enumerate(splits):
        near = F.when(F.abs(F.col("x") - s) <= wide, F.lit(i)).otherwise(near)
    marked = heads.withColumn("split", near)
    border = marked.where(F.col("split").isNotNull())

    def sweep(pdf):
        pdf = pdf.sort_values(["y", "id"], kind="stable")
        kept = []
        for r in pdf.itertuples(index=False):
            if kept and max(abs(r.x - kept[-1].x) / wide, abs(r.y - kept[-1].y) / tall) < 1:
                if (r.z, r.id) < (kept[-1].z, kept[-1].id):
                    kept[-1] = r
            else:
                kept.append(r)
        import pandas as pd

        return pd.DataFrame(kept, columns=pdf.columns)

    schema = T.StructType(border.schema.fields)
    return marked.where(F.col("split").isNull()).unionByName(border.groupBy("split").applyInPandas(sweep, schema)).drop("split")


def hover_box(hulls: DataFrame) -> DataFrame:
    """(level, head, minx, miny, maxx, maxy): the box around each hull, as a boundary to show on hover."""
    xs, ys = F.transform("hull", lambda p: p["x"]), F.transform("hull", lambda p: p["y"])
    return hulls.select("level", "head", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
