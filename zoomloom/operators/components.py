"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoomloom.session import discard, materialize

EDGES_PER_TASK = 200_000
MAX_ROUNDS = 60


def union_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes, for edges a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
    return label


def connected_components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root): the least node of the component of every node of edges (a long, b long).

    Tasks of about edges_per_task edges join up what they have, which leaves one edge a node and task; where all edges make one task this is the
    result. Rounds of large-star and small-star, each written to the shared folder, do the rest. Null ends are left out; loops and
    repeated edges do no harm; an empty table gives an empty result.
    """
    e = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    tasks = max(1, math.ceil(e.count() / edges_per_task))

    def join_up(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            nodes, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
            root = nodes[union_labels(len(nodes), at[: t.num_rows], at[t.num_rows :])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "root"])

    joined = e.repartition(tasks).mapInArrow(join_up, "node long, root long")
    if tasks == 1:
        return joined
    joined = materialize(joined)
    discard(e)
    nodes, e, before = joined.select("node").distinct(), joined.toDF("a", "b").where("a <> b").distinct(), None
    last = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = materialize(down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        if before is not None:
            discard(before)
        before = e
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        last = now
    raise RuntimeError("connected_components did not end")
