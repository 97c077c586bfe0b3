"""Clusters of points that crowd together: mergeable cluster-feature trees, Ward agglomeration of their leaves, one assignment pass.

Plan
1. Each partition builds a cluster-feature tree over its rows: leaves are cells half as wide as it takes for all their members to be
   linked, and hold count, linear sums, square sum and bounds. Features of one cell merge by addition, whatever partitions they come
   from; so a place has a bounded number of leaves however many rows, or copies of rows, lie there.
2. The merged leaves, not the rows, are spread over tasks by a quadtree, each with the leaves in reach around it.
3. Leaves are linked if their bounds say that all, or no, members are within the link distance. Linked leaves are agglomerated in Ward's
   order (least growth of the squared error first) until no link is left; clusters of several tasks are joined through the leaves they share.
4. Exact check: where bounds leave open whether two clusters are linked, the members that could link them are divided into finer and finer
   features until the bounds tell.
5. One pass over all rows assigns each to the crowd of its leaf; sizes count distinct records.
6. `describe_crowds` merges the features of each crowd, condenses them to a bounded number of leaves, and cuts Ward's dendrogram of those: the
   parts of a crowd, the centre of the main one, and the members nearest to it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoomloom.operators.balance import expand_ranges, pack_units, task_count
from zoomloom.operators.components import connected_components
from zoomloom.operators.spatial_join import shape_quadtree
from zoomloom.session import materialize, parallelism

LEAVES_PER_TASK = 100_000
HELD = 500_000  # leaves a partition's tree holds before it gives them away
FINER = 16  # division of a leaf's side in each round of the exact check
MAX_ROUNDS = 20
SIDE = 16  # condensed leaves along the longer side of a crowd
PART = 0.25  # share of a crowd's squared error that no merge within a part may add

SUMS = ("n", "sx", "sy", "ss")
LOWS, HIGHS = ("x0", "y0"), ("x1", "y1")


class FeatureTree:
    """Cluster features (count, linear sums, square sum, bounds) over cells of one width, sorted by cell; a parent is a cell twice as wide."""

    def __init__(self, width: float, cell_x, cell_y, columns: dict[str, np.ndarray]):
        order = np.lexsort((cell_y, cell_x))
        cx, cy = cell_x[order], cell_y[order]
        new = np.concatenate([[True], (np.diff(cx) != 0) | (np.diff(cy) != 0)]) if len(cx) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.width, self.leaf = width, np.empty(len(cx), dtype=np.int64)
        self.leaf[order] = np.cumsum(new) - 1
        self.cell_x, self.cell_y = cx[starts], cy[starts]
        for names, f in ((SUMS, np.add), (LOWS, np.minimum), (HIGHS, np.maximum)):
            for c in names:
                v = columns[c][order]
                setattr(self, c, f.reduceat(v, starts) if len(v) else v)

    @classmethod
    def of_points(cls, x, y, width: float, n=None) -> FeatureTree:
        n = np.ones(len(x)) if n is None else n.astype(np.float64)
        return cls(width, np.floor(x / width), np.floor(y / width), {"n": n, "sx": n * x, "sy": n * y, "ss": n * (x * x + y * y), "x0": x, "x1": x, "y0": y, "y1": y})

    def __len__(self) -> int:
        return len(self.cell_x)

    def columns(self) -> dict[str, np.ndarray]:
        return {c: getattr(self, c) for c in (*SUMS, *LOWS, *HIGHS)}

    def merge(self, other: FeatureTree) -> FeatureTree:
        a, b = self.columns(), other.columns()
        return FeatureTree(self.width, np.concatenate([self.cell_x, other.cell_x]), np.concatenate([self.cell_y, other.cell_y]), {c: np.concatenate([a[c], b[c]]) for c in a})

    def parents(self) -> FeatureTree:
        """The next level of the tree; its `leaf` tells the parent of each of these."""
        return FeatureTree(2 * self.width, np.floor(self.cell_x / 2), np.floor(self.cell_y / 2), self.columns())

    def neighbours(self, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of all pairs of cells at most `apart` from each other in either direction, each once."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ux, rx = np.unique(self.cell_x, return_inverse=True)
        uy, ry = np.unique(self.cell_y, return_inverse=True)
        code = rx.astype(np.int64) * len(uy) + ry
        out_a, out_b = [], []
        for dx in range(apart + 1):
            at = np.searchsorted(ux, self.cell_x + dx)
            a = np.flatnonzero((at < len(ux)) & (ux[np.minimum(at, len(ux) - 1)] == self.cell_x + dx))
            base = at[a] * len(uy)
            lo = np.searchsorted(code, base + np.searchsorted(uy, self.cell_y[a] + (1 if dx == 0 else -apart)), "left")
            hi = np.searchsorted(code, base + np.searchsorted(uy, self.cell_y[a] + apart, "right"), "left")
            owner, b = expand_ranges(lo, hi)
            out_a.append(a[owner])
            out_b.append(b)
        return np.concatenate(out_a), np.concatenate(out_b)


def nearest_and_farthest(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Squared least and greatest distance that members of two boxes (x0, y0, x1, y1) may have."""
    near = np.maximum(0, np.maximum(a[0] - b[2], b[0] - a[2])) ** 2 + np.maximum(0, np.maximum(a[1] - b[3], b[1] - a[3])) ** 2
    far = np.maximum(a[2] - b[0], b[2] - a[0]) ** 2 + np.maximum(a[3] - b[1], b[3] - a[1]) ** 2
    return near, far


def ward(n, sx, sy, a, b, most: float = float("inf")):
    """Merge linked features in Ward's order until no linked pair is left: (root of each feature, [(cost, root, root)]).

    The cost of a merge is the growth of the sum of squared distances to the centres. Ties go to the lower numbers. Merges
    that cost more than `most` are not done.
    """
    n, sx, sy = n.tolist(), sx.tolist(), sy.tolist()
    root = list(range(len(n)))
    near: dict[int, set[int]] = {}
    for i, j in zip(a.tolist(), b.tolist()):
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)

    def cost(i: int, j: int) -> float:
        dx, dy = sx[i] / n[i] - sx[j] / n[j], sy[i] / n[i] - sy[j] / n[j]
        return n[i] * n[j] / (n[i] + n[j]) * (dx * dx + dy * dy)

    version = dict.fromkeys(near, 0)
    heap = [(cost(i, j), i, j, 0, 0) for i in near for j in near[i] if i < j]
    heapq.heapify(heap)
    merges = []
    while heap:
        c, i, j, vi, vj = heapq.heappop(heap)
        if version.get(i) != vi or version.get(j) != vj:
            continue
        if c > most:
            break
        if len(near[j]) > len(near[i]):
            i, j = j, i
        root[j] = i
        merges.append((c, i, j))
        n[i], sx[i], sy[i] = n[i] + n[j], sx[i] + sx[j], sy[i] + sy[j]
        del version[j]
        version[i] += 1
        for k in near.pop(j):
            near[k].discard(j)
            if k != i:
                near[k].add(i)
                near[i].add(k)
        for k in near[i]:
            lo, hi = (i, k) if i < k else (k, i)
            heapq.heappush(heap, (cost(lo, hi), lo, hi, version[lo], version[hi]))
    label = np.array(root, dtype=np.int64)
    while True:
        nxt = label[label]
        if np.array_equal(nxt, label):
            return label, merges
        label = nxt


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Features of the same keys merged: the trees of all partitions become one."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in LOWS], *[F.max(c).alias(c) for c in HIGHS])


def feature_leaves(points: DataFrame, width: float) -> DataFrame:
    """(kx, ky, n, sx, sy, ss, x0, y0, x1, y1): the merged leaves of all partitions' trees over points (x double, y double)."""

    def build(batches):
        def give(t: FeatureTree):
            yield pa.RecordBatch.from_arrays([pa.array(t.cell_x), pa.array(t.cell_y), *map(pa.array, t.columns().values())], names=["kx", "ky", *t.columns()])

        tree = None
        for b in batches:
            if b.num_rows:
                one = FeatureTree.of_points(b.column(0).to_numpy(), b.column(1).to_numpy(), width)
                tree = one if tree is None else tree.merge(one)
                if len(tree) > HELD:
                    yield from give(tree)
                    tree = None
        if tree is not None:
            yield from give(tree)

    columns = ", ".join(f"{c} double" for c in ("kx", "ky", *SUMS, *LOWS, *HIGHS))
    return _merged(points.select("x", "y").mapInArrow(build, columns), "kx", "ky")


def crowd_members(points: DataFrame, reach: float, least: int, tasks: int | None = None) -> DataFrame:
    """(cluster_id, id) of all crowds of points (id long, x double, y double).

    Two points are linked if they are at most `reach` apart; a crowd is all points linked directly or through others, with
    at least `least` different ids; cluster_id is its smallest id. Rows with a null id or a null, NaN or infinite coordinate take no
    part. Rows repeated unchanged are one record. An empty table gives an empty result. A task holds the leaves of at least one square
    of four reaches, some hundred at most, however crowded it is.
    """
    spark = points.sparkSession
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    valid = points.select("id", "x", "y").where(F.col("id").isNotNull() & finite)
    width = reach / np.sqrt(8) * (1 - 1e-12)  # two leaves side by side are within reach as a whole
    leaves = materialize(feature_leaves(valid, width).withColumn("leaf", F.monotonically_increasing_id()))
    told = leaves.agg(F.count(F.lit(1)), F.sum("n")).first()
    total, rows = told[0], told[1] or 0.0
    tasks = tasks or task_count(total, parallelism(spark), LEAVES_PER_TASK)
    tree, load = shape_quadtree(leaves.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), total, tasks, 4 * reach)
    bins = pack_units(load, tasks)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            x0, y0, x1, y1 = (t[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            row, region = tree.leaves(mx, my, mx, my)
            home = np.empty(len(x0), dtype=np.int64)
            home[row] = region
            pad = reach + 2 * width
            row, region = tree.leaves(x0 - pad, y0 - pad, x1 + pad, y1 + pad)
            keep = region >= home[row]  # a pair across two regions is found in the later one
            row, region = row[keep], region[keep]
            shared = np.bincount(row, minlength=len(x0)) > 1
            out = t.take(pa.array(row))
            for name, v in (("home", region == home[row]), ("shared", shared[row]), ("region", region.astype(np.int32)), ("bin", bins[region])):
                out = out.append_column(name, pa.array(v))
            yield from out.to_batches()

    def agglomerate(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        region = t["region"].to_numpy()
        order = np.argsort(region, kind="stable")
        cuts = np.flatnonzero(np.diff(region[order])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(order)]):
            part = t.take(pa.array(order[lo:hi]))
            c = {k: part[k].to_numpy(zero_copy_only=False) for k in ("leaf", "kx", "ky", *SUMS, *LOWS, *HIGHS, "home", "shared")}
            f = FeatureTree(width, c["kx"], c["ky"], c)
            at = np.empty(len(f), dtype=np.int64)
            at[f.leaf] = np.arange(len(f))
            ident, home, shared = c["leaf"][at], c["home"][at], c["shared"][at]
            a, b = f.neighbours(3)
            own = home[a] | home[b]
            a, b = a[own], b[own]
            box = (f.x0, f.y0, f.x1, f.y1)
            near, far = nearest_and_farthest([v[a] for v in box], [v[b] for v in box])
            sure = far <= reach * reach
            label = ward(f.n, f.sx, f.sy, a[sure], b[sure])[0]
            maybe = np.flatnonzero(~sure & (near <= reach * reach) & (label[a] != label[b]))
            size = np.bincount(label, weights=f.n, minlength=len(f))
            open_ = np.bincount(label, weights=shared, minlength=len(f)) > 0
            open_[label[a[maybe]]] = True
            open_[label[b[maybe]]] = True
            keep = np.flatnonzero(open_[label] | (size[label] >= least))  # the rest is complete and too small
            # leaves with their label, then pairs of leaves that only their members can tell about
            none, no = np.zeros(len(maybe)), np.zeros(len(maybe), bool)
            for columns in ((np.zeros(len(keep), bool), ident[keep], ident[label[keep]], f.cell_x[keep], f.cell_y[keep], f.n[keep], home[keep], shared[keep]), (~no, ident[a[maybe]], ident[b[maybe]], none, none, none, no, no)):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["ask", "a", "b", "kx", "ky", "n", "home", "shared"])

    columns = ", ".join(f"{c} double" for c in ("kx", "ky", *SUMS, *LOWS, *HIGHS)) + ", leaf long"
    routed = leaves.mapInArrow(route, columns + ", home boolean, shared boolean, region int, bin int").repartitionById(tasks, F.col("bin"))
    local = materialize(routed.mapInArrow(agglomerate, "ask boolean, a long, b long, kx double, ky double, n double, home boolean, shared boolean"))
    meet = local.where("not ask and shared").groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("labels"))
    roots = connected_components(meet.select(F.explode("labels").alias("a"), "b"))
    label = materialize(local.where("not ask and home").select(F.col("a").alias("leaf"), F.col("b").alias("node"), "kx", "ky", "n").join(roots, "node", "left").select("leaf", "kx", "ky", "n", F.coalesce("root", "node").alias("root")))
    own = label.select("leaf", "root")
    asked = local.where("ask").select("a", "b").distinct().join(own.toDF("a", "ra"), "a").join(own.toDF("b", "rb"), "b").where("ra <> rb")
    linked = linked_leaves(asked, leaves, valid, reach, width)
    if linked is not None:
        again = connected_components(linked.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        label = materialize(label.join(again.toDF("root", "up"), "root", "left").select("leaf", "kx", "ky", "n", F.coalesce("up", "root").alias("root")))
    crowded = label.groupBy("root").agg(F.sum("n").alias("rows")).where(F.col("rows") >= least).select("root")
    known = materialize(label.join(crowded, "root").select("kx", "ky", "n", "root"))
    members = materialize(assign(valid, known, width, rows / tasks / 4))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cluster_id")).where(F.col("n") >= least)
    return members.join(sizes, "root").select("cluster_id", "id")


def _floor(v: Column) -> Column:
    """The whole number below v, as a double; doubles that large are whole themselves and would not fit a long."""
    return F.when(F.abs(v) < 9e15, F.floor(v).cast("double")).otherwise(v)


def _celled(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({"kx": _floor(F.col("x") / F.lit(width)), "ky": _floor(F.col("y") / F.lit(width))})


def assign(points: DataFrame, known: DataFrame, width: float, many: float) -> DataFrame:
    """(root, id), each once: every point gets the root of its leaf (kx, ky, n, root). Leaves that hold more than `many` rows, a quarter of a task's
    fair share, are fewer than four a task, so their labels are broadcast; the rows of all others are joined by a shuffle that no leaf can overload."""
    heavy = F.col("n") > max(many, 1_000)
    rows = _celled(points, width).select("id", "kx", "ky")
    big = F.broadcast(known.where(heavy).select("kx", "ky", "root"))
    rest = rows.join(big, ["kx", "ky"], "left_anti").join(known.where(~heavy).select("kx", "ky", "root"), ["kx", "ky"])
    return rows.join(big, ["kx", "ky"]).select("root", "id").unionByName(rest.select("root", "id")).distinct()


def linked_leaves(asked: DataFrame, leaves: DataFrame, points: DataFrame, reach: float, width: float) -> DataFrame | None:
    """Those pairs (a, b, ra, rb) of leaves that have members within reach; None if no pair is asked.

    The members of a that are in reach of b's bounds, and the other way round, become features of cells FINER times as narrow: at most
    FINER x FINER a side whatever their number. Bounds that leave a pair open are refined again; a feature of one position is exact.
    """
    asked = materialize(asked)
    if asked.isEmpty():
        return None
    box = ["x0", "y0", "x1", "y1"]
    ends = asked.select(F.col("a").alias("leaf")).union(asked.select(F.col("b").alias("leaf"))).distinct()
    bounds = materialize(leaves.join(ends, "leaf", "left_semi").select("leaf", "kx", "ky", *box))  # mostly few, so Spark knows it may send them to the rows
    places = materialize(_celled(points.select("x", "y"), width).join(bounds.select("leaf", "kx", "ky"), ["kx", "ky"]).select("leaf", "x", "y").distinct())
    bounds = bounds.select("leaf", *box)
    found = None
    for _ in range(MAX_ROUNDS):
        width /= FINER
        sides = asked.select("a", "b", F.col("a").alias("leaf"), F.col("b").alias("other"), F.lit(True).alias("left")).union(asked.select("a", "b", F.col("b"), F.col("a"), F.lit(False)))
        sides = sides.join(bounds.toDF("other", *box), "other")
        dx = F.greatest(F.lit(0.0), F.col("x0") - F.col("x"), F.col("x") - F.col("x1"))
        dy = F.greatest(F.lit(0.0), F.col("y0") - F.col("y"), F.col("y") - F.col("y1"))
        close = places.join(sides, "leaf").where(dx * dx + dy * dy <= reach * reach).select("a", "b", "left", "x", "y")
        cells = _celled(close, width).groupBy("a", "b", "left", "kx", "ky").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        lists = cells.groupBy("a", "b").agg(*[F.collect_list(F.when(F.col("left") if one else ~F.col("left"), F.array(*box))).alias(c) for c, one in (("one", True), ("two", False))])

        def decide(batches):
            for b in batches:
                verdict = []
                for one, two in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    p, q = (np.array(v, dtype=np.float64).reshape(-1, 4).T for v in (one, two))
                    near, far = nearest_and_farthest([v[:, None] for v in p], list(q))
                    verdict.append(1 if (far <= reach * reach).any() else 2 if (near <= reach * reach).any() else 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(verdict, pa.int32())], names=["a", "b", "verdict"])

        told = materialize(lists.select("a", "b", "one", "two").mapInArrow(decide, "a long, b long, verdict int").join(asked, ["a", "b"]))
        hit = told.where("verdict = 1").drop("verdict")
        found = hit if found is None else found.unionByName(hit)
        asked = told.where("verdict = 2").drop("verdict")
        if asked.isEmpty():
            return found
    raise RuntimeError("positions too close to tell apart")


def describe_crowds(members: DataFrame, points: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, center_x, center_y, radius, parts, main_x, main_y, typical) of every crowd.

    Size, centre and radius (root mean squared distance to the centre) come from the merged features of the crowd. Its features are condensed to
    at most about SIDE x SIDE leaves, and Ward's dendrogram of these is cut before the first merge that would add more than PART of the crowd's
    squared error: parts counts what is left, (main_x, main_y) is the centre of the largest part (ties to the lower left), and
    typical has the ids nearest to it (ties to the smaller id). Rings and chains thus get members that exist where most of them are.
    """
    own = materialize(members.join(points.select("id", "x", "y").distinct(), "id").select("cluster_id", "id", "x", "y"))
    span = own.groupBy("cluster_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    # a power of two, so that leaves of any crowd are whole branches of one tree
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("span"), F.lit(1e-9)) / SIDE)))
    sized = own.join(span.select("cluster_id", width.alias("w")), "cluster_id")
    one = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "ss": F.col("x") * F.col("x") + F.col("y") * F.col("y"), "x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")}
    cells = sized.withColumns({"kx": _floor(F.col("x") / F.col("w")), "ky": _floor(F.col("y") / F.col("w"))}).withColumns(one)
    names = ["kx", "ky", *SUMS, *LOWS, *HIGHS]
    condensed = _merged(cells, "cluster_id", "kx", "ky").groupBy("cluster_id").agg(*[F.collect_list(F.array(*names)).alias("leaves")])

    def cut(batches):
        for b in batches:
            out = []
            for leaves in b.column(1).to_pylist():
                v = dict(zip(names, np.array(leaves, dtype=np.float64).T))
                f = FeatureTree(1.0, v["kx"], v["ky"], v)
                n, sx, sy = f.n.sum(), f.sx.sum(), f.sy.sum()
                error = max(0.0, f.ss.sum() - (sx * sx + sy * sy) / n)
                label = ward(f.n, f.sx, f.sy, *np.triu_indices(len(f), 1), most=PART * error)[0]
                size = np.bincount(label, weights=f.n)
                cx, cy = np.bincount(label, weights=f.sx), np.bincount(label, weights=f.sy)
                at = np.flatnonzero(size)
                best = min(at.tolist(), key=lambda i: (-size[i], cx[i] / size[i], cy[i] / size[i]))
                out.append((int(n), sx / n, sy / n, float(np.sqrt(error / n)), len(at), cx[best] / size[best], cy[best] / size[best]))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64() if i in (0, 4) else pa.float64()) for i, c in enumerate(cols)]], names=["cluster_id", "size", "center_x", "center_y", "radius", "parts", "main_x", "main_y"])

    told = materialize(condensed.mapInArrow(cut, "cluster_id long, size long, center_x double, center_y double, radius double, parts long, main_x double, main_y double"))
    away = (F.col("x") - F.col("main_x")) ** 2 + (F.col("y") - F.col("main_y")) ** 2
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy("away", "id"))
    near = own.join(told.select("cluster_id", "main_x", "main_y"), "cluster_id").select("cluster_id", "id", away.alias("away")).withColumn("place", place).where(F.col("place") <= typical)
    picked = near.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "id")))["id"].alias("typical"))
    return told.join(picked, "cluster_id")
