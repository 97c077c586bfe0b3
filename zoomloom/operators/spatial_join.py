"""Distance and containment joins of boxes: sample-driven quadtree, boundary replication, R-tree probing.

Plan
1. A sample of box centres (SAMPLE_PER_TASK for each task) shapes a quadtree; the sample decides balance, never results.
   Leaves are bin-packed to tasks by their estimated rows and candidates. A leaf that cannot be divided further and still
   exceeds a fair share is cut into shards by a hash of the id, and each pair of shards is compared on its own.
2. Every box, grown by half the distance, is replicated to each leaf it touches; every region likewise.
3. Each task bulk-loads an R-tree per leaf (sort-tile-recursive) and probes it level by level in arrays.
4. The exact distance test follows. A pair found in several leaves comes out only in the one that holds its
   reference point, the lower-left corner of the intersection of both grown boxes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoomloom.operators.balance import expand_ranges, pack_pairs, pair_slots, task_count
from zoomloom.session import parallelism

SAMPLE = 40_000  # at least
SAMPLE_PER_TASK = 64
ROWS_PER_TASK = 100_000
FANOUT = 16
FRONTIER = 1_000_000


class Quadtree:
    """Leaves over the whole plane: the outer edges are infinite. Children are ordered (low, low), (high, low), (low, high), (high, high)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, capacity: int, least_side: float):
        x0, x1 = (float(x.min()), float(x.max())) if len(x) else (0.0, 1.0)
        y0, y1 = (float(y.min()), float(y.max())) if len(y) else (0.0, 1.0)
        side = max(x1 - x0, y1 - y0, least_side, 1e-6)
        child, mid_x, mid_y, count, bounds, sides = [], [], [], [], [], []
        inf = float("inf")
        todo = [(np.arange(len(x)), x0, y0, side, (-inf, -inf, inf, inf), -1, 0)]
        for rows, ox, oy, s, b, parent, k in todo:  # grows as it runs
            me = len(child)
            if parent >= 0:
                child[parent][k] = me
            child.append([-1] * 4)
            mx, my = ox + s / 2, oy + s / 2
            mid_x.append(mx)
            mid_y.append(my)
            count.append(len(rows))
            bounds.append(b)
            sides.append(s)
            if len(rows) > capacity and s / 2 >= least_side:
                right, up = x[rows] >= mx, y[rows] >= my
                for q in range(4):
                    r, u = bool(q & 1), bool(q & 2)
                    todo.append((rows[(right == r) & (up == u)], mx if r else ox, my if u else oy, s / 2, (mx if r else b[0], my if u else b[1], b[2] if r else mx, b[3] if u else my), me, q))
        self.child, self.mid_x, self.mid_y = np.array(child, dtype=np.int64), np.array(mid_x), np.array(mid_y)
        self.is_leaf = self.child[:, 0] < 0
        self.leaf_of = np.where(self.is_leaf, np.cumsum(self.is_leaf) - 1, -1)
        self.count = np.array(count)[self.is_leaf]
        self.bounds = np.array(bounds)[self.is_leaf]
        self.side = np.array(sides)[self.is_leaf]

    def leaves(self, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the closed boxes touch; leaves are half-open, so a point lies in one."""
        row, node = np.arange(len(x0)), np.zeros(len(x0), dtype=np.int64)
        out_r, out_l = [], []
        while len(row):
            end = self.is_leaf[node]
            out_r.append(row[end])
            out_l.append(self.leaf_of[node[end]])
            row, node = row[~end], node[~end]
            low_x, high_x = x0[row] < self.mid_x[node], x1[row] >= self.mid_x[node]
            low_y, high_y = y0[row] < self.mid_y[node], y1[row] >= self.mid_y[node]
            picks = [low_x & low_y, high_x & low_y, low_x & high_y, high_x & high_y]
            row, node = np.concatenate([row[p] for p in picks]), np.concatenate([self.child[node[p], q] for q, p in enumerate(picks)])
        return np.concatenate(out_r), np.concatenate(out_l)


class PackedRTree:
    """Sort-tile-recursive R-tree over arrays of boxes; levels from the entries up to one node."""

    def __init__(self, x0, y0, x1, y1, fanout: int = FANOUT):
        n = len(x0)
        slices = max(1, int(np.ceil(np.sqrt(n / fanout))))
        by_x = np.argsort(x0 + x1, kind="stable")
        slot = np.empty(n, dtype=np.int64)
        slot[by_x] = np.arange(n) // max(1, -(-n // slices))
        self.order = np.lexsort((y0 + y1, slot))
        self.fanout = fanout
        self.levels = [tuple(c[self.order] for c in (x0, y0, x1, y1))]
        while len(self.levels[-1][0]) > fanout:
            a, b, c, d = self.levels[-1]
            at = np.arange(0, len(a), fanout)
            self.levels.append((np.minimum.reduceat(a, at), np.minimum.reduceat(b, at), np.maximum.reduceat(c, at), np.maximum.reduceat(d, at)))

    def probe(self, x0, y0, x1, y1):
        """Yield (probe, entry): all pairs whose closed boxes meet; in blocks of probes and of frontier."""
        if not len(self.order):
            return
        step = max(1, FRONTIER // (self.fanout * 8))
        for at in range(0, len(x0), step):
            p = np.arange(at, min(at + step, len(x0)))
            top = len(self.levels[-1][0])
            stack = [(len(self.levels) - 1, np.repeat(p, top), np.tile(np.arange(top), len(p)))]
            while stack:
                level, q, node = stack.pop()
                a, b, c, d = self.levels[level]
                hit = (a[node] <= x1[q]) & (c[node] >= x0[q]) & (b[node] <= y1[q]) & (d[node] >= y0[q])
                q, node = q[hit], node[hit]
                if not level:
                    if len(q):
                        yield q, self.order[node]
                    continue
                below = len(self.levels[level - 1][0])
                most = max(1, FRONTIER // self.fanout)
                for i in range(0, len(q), most):
                    owner, kid = expand_ranges(node[i : i + most] * self.fanout, np.minimum((node[i : i + most] + 1) * self.fanout, below))
                    stack.append((level - 1, q[i : i + most][owner], kid))


def clean_boxes(df: DataFrame, ident: str, corners=("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """(i, x0, y0, x1, y1): corners put right; rows with a null id or a null or NaN corner left out."""
    a, b, c, d = (F.col(n).cast("double") for n in corners)
    ok = F.col(ident).isNotNull()
    for v in (a, b, c, d):
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return df.where(ok).select(F.col(ident).cast("long").alias("i"), F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def unique_rows(*columns) -> np.ndarray:
    """Indices of one row for each distinct combination."""
    order = np.lexsort(columns)
    same = np.ones(len(order), dtype=bool)
    if len(order):
        same[0] = False
    for c in columns:
        same[1:] &= c[order[1:]] == c[order[:-1]]
    return order[~same]


def shape_quadtree(points: DataFrame, total: int, tasks: int, least_side: float) -> tuple[Quadtree, np.ndarray]:
    """Quadtree of a sample of points (x, y) that grows with the number of tasks, and the estimated rows of its leaves."""
    wanted = max(SAMPLE, SAMPLE_PER_TASK * tasks)
    fraction = min(1.0, wanted / max(total, 1))
    sample = (points.sample(False, fraction, 7) if fraction < 1 else points).toArrow()
    x, y = sample["x"].to_numpy(), sample["y"].to_numpy()
    whole = np.isfinite(x) & np.isfinite(y)  # others lie in the outer leaves
    x, y = x[whole], y[whole]
    tree = Quadtree(x, y, max(8, len(x) // (tasks * 6)), least_side)
    return tree, (tree.count + 1.0) / fraction


def near_and_inside(
    boxes: DataFrame,
    regions: DataFrame | None,
    distance: float,
    tasks: int | None = None,
) -> DataFrame:
    """All pairs of boxes at most `distance` apart, and all boxes that lie wholly in a region.

    boxes and regions come from clean_boxes: (i, x0, y0, x1, y1). Result: (kind, key_a, key_b); kind 'near' has the
    ids of two boxes, the smaller first (closed boxes, Euclidean distance of their nearest points, 0 when they
    overlap); kind 'inside' has the id of the region and that of the box. Rows repeated unchanged are one record;
    one id with several boxes counts as one record at several places, but makes no pair with itself. Empty inputs give an
    empty result. Without regions only 'near' comes out.
    """
    spark = boxes.sparkSession
    total = boxes.count()
    tasks = tasks or task_count(total, parallelism(spark), ROWS_PER_TASK)
    half = distance / 2
    tree, rows = shape_quadtree(boxes.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), total, tasks, max(8 * distance, 1e-3))
    near = rows * np.minimum(1.0, (3 * distance / tree.side) ** 2)  # candidates of a box, were the leaf evenly filled
    shards, first, bins = pack_pairs(rows * (1.0 + near), rows, tasks, 4 * ROWS_PER_TASK)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            box = [t[c].to_numpy() for c in ("x0", "y0", "x1", "y1")]
            region = t["region"].to_numpy(zero_copy_only=False)
            grow = np.where(region, 0.0, half)
            row, leaf = tree.leaves(box[0] - grow, box[1] - grow, box[2] + grow, box[3] + grow)
            n = shards[leaf]
            own = t["split"].to_numpy()[row] % n
            at, slot, cross = pair_slots(own, np.where(region[row], 0, n))
            # a region meets every box once: in the slots of a shard with itself
            r_at, r_own = expand_ranges(np.zeros(len(row), dtype=np.int64), np.where(region[row], n, 0))
            at, slot = np.concatenate([at, r_at]), np.concatenate([slot, r_own * (r_own + 1) // 2 + r_own])
            cross = np.concatenate([cross, np.full(len(r_at), -1)])
            row, leaf = row[at], leaf[at]
            slot = first[leaf] + slot
            out = t.select(["i", "x0", "y0", "x1", "y1", "region"]).take(pa.array(row))
            for name, v in (("cross", cross), ("leaf", leaf.astype(np.int32)), ("slot", slot.astype(np.int32)), ("bin", bins[slot])):
                out = out.append_column(name, pa.array(v))
            yield from out.to_batches()

    def join(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        cols = {c: t[c].to_numpy() for c in ("i", "x0", "y0", "x1", "y1", "region", "cross", "leaf", "slot")}
        keep = unique_rows(cols["y1"], cols["x1"], cols["y0"], cols["x0"], cols["i"], cols["region"], cols["slot"])
        cols = {c: v[keep] for c, v in cols.items()}
        cuts = np.flatnonzero(np.diff(cols["slot"])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cols["slot"])]):
            c = {k: v[lo:hi] for k, v in cols.items()}
            bx0, by0, bx1, by1 = tree.bounds[c["leaf"][0]]
            r = np.flatnonzero(c["region"])
            o = np.flatnonzero(~c["region"])
            i, x0, y0, x1, y1, cross = (c[k][o] for k in ("i", "x0", "y0", "x1", "y1", "cross"))
            # two shards: one is indexed, the other probes
            if len(cross) and cross[0] >= 0:
                low, high = cross.min(), cross.max()
                one, two = np.flatnonzero(cross == low), np.flatnonzero((cross == high) & (low < high))
            else:
                one = two = np.arange(len(cross))
            index = PackedRTree(x0[two], y0[two], x1[two], y1[two])
            for p, q in index.probe(x0[one] - distance, y0[one] - distance, x1[one] + distance, y1[one] + distance):
                a, b = one[p], two[q]
                if cross[0] >= 0:  # either may have the smaller id
                    a, b = np.where(i[a] < i[b], a, b), np.where(i[a] < i[b], b, a)
                dx = np.maximum(0.0, np.maximum(x0[a] - x1[b], x0[b] - x1[a]))
                dy = np.maximum(0.0, np.maximum(y0[a] - y1[b], y0[b] - y1[a]))
                rx, ry = np.maximum(x0[a], x0[b]) - half, np.maximum(y0[a], y0[b]) - half
                ok = (i[a] < i[b]) & (dx * dx + dy * dy <= distance * distance) & (rx >= bx0) & (rx < bx1) & (ry >= by0) & (ry < by1)
                if ok.any():
                    yield _rows("near", i[a[ok]], i[b[ok]])
            if len(r):
                vi, vx0, vy0, vx1, vy1 = (c[k][r] for k in ("i", "x0", "y0", "x1", "y1"))
                for p, q in index.probe(vx0, vy0, vx1, vy1):
                    q = two[q]
                    ok = (x0[q] >= vx0[p]) & (x1[q] <= vx1[p]) & (y0[q] >= vy0[p]) & (y1[q] <= vy1[p])
                    ok &= (x0[q] >= bx0) & (x0[q] < bx1) & (y0[q] >= by0) & (y0[q] < by1)
                    if ok.any():
                        yield _rows("inside", vi[p[ok]], i[q[ok]])

    sides = boxes.withColumn("region", F.lit(False))
    if regions is not None:
        sides = sides.unionByName(regions.withColumn("region", F.lit(True)))
    routed = sides.withColumn("split", F.xxhash64("i").bitwiseAND(F.lit(0x7FFFFFFF))).mapInArrow(route, "i long, x0 double, y0 double, x1 double, y1 double, region boolean, cross long, leaf int, slot int, bin int")
    return routed.repartitionById(tasks, F.col("bin")).mapInArrow(join, "kind string, key_a long, key_b long")


def _rows(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=object), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "key_a", "key_b"])
