"""Filling containers of fixed capacity with items of varying length: vector bin packing by dot product.

Plan
1. Items are dealt out to tasks evenly, so each task packs a like mixture. Items longer than the capacity are cut into
   full pieces, which fill a container each, and one remainder.
2. A container is filled greedily: of all items that fit all limits (tokens, segments, loss-bearing tokens), the one
   whose demand has the greatest dot product with the space left goes in, until none fits. Items of equal demand are handled as
   one kind with a count, in blocks of at most BLOCK items and as many carried over.
3. A container is closed when it is CLOSED full or when no item of all that are still open, anywhere, could enter it. The items of the
   others are dealt out anew, to as many tasks as they ask for, and packed again with the leftovers of other tasks. This ends
   as soon as a level needs hardly fewer containers than the one before (GAIN), so items that cannot be paired stay where they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoomloom.session import check_names, materialize, parallelism

BLOCK = 8_192
CLOSED = 0.97
ITEMS_PER_TASK = 50_000
GAIN = 0.01  # a level that saves a smaller share of the containers it was given is the last one


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of every item; demand is (items, dimensions), each at most its limit."""
    out = np.full(len(demand), -1, dtype=np.int64)
    if not len(demand):
        return out
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(-(kinds / limits).sum(1), kind="stable")  # an empty container takes the first that is left
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    kinds, kind = kinds[order], place[kind.ravel()]
    members = np.argsort(kind, kind="stable")
    count = np.bincount(kind)
    ends = np.cumsum(count)  # the members of a kind are taken from the back
    sizes = [np.ascontiguousarray(c) for c in kinds.T]
    parts = [c / m for c, m in zip(sizes, limits.tolist())]
    container, first = 0, 0
    while first < len(count):
        space = limits.tolist()
        k, open_ = first, None
        while True:
            count[k] -= 1
            ends[k] -= 1
            out[members[ends[k]]] = container
            space = [s - int(c[k]) for s, c in zip(space, sizes)]
            if min(space) < 0 or not any(space):
                break
            if open_ is None:
                fits = count[first:] > 0
                for s, c in zip(space, sizes):
                    fits &= c[first:] <= s
                open_ = np.flatnonzero(fits) + first
            else:
                fits = count[open_] > 0
                for s, c in zip(space, sizes):
                    fits &= c[open_] <= s
                open_ = open_[fits]
            if not len(open_):
                break
            score = sum(p[open_] * (s / m) for p, s, m in zip(parts, space, limits.tolist()))
            k = int(open_[score.argmax()])
        container += 1
        while first < len(count) and not count[first]:
            first += 1
    return out


def _totals(container: np.ndarray, demand: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(container, weights=d) for d in demand.T], axis=1)


def pack(
    items: DataFrame,
    ident: str,
    size: str,
    capacity: int,
    most_segments: int | None = None,
    loss: str | None = None,
    most_loss: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """(ident, piece_no, start_token, n_tokens, n_loss, container_id): where each (piece of an) item lies.

    A container holds at most `capacity` tokens, `most_segments` pieces and `most_loss` loss-bearing tokens (of the column
    `loss`, or all tokens where none is named; a piece of a cut item bears loss in proportion, rounded up). Items longer than the
    capacity are cut into full pieces and a remainder, others stay whole. A piece with more loss-bearing tokens than a container may
    hold has the surplus masked: it is placed like any other, and its n_loss, which is most_loss then, reports it. Items of null or no size,
    and those with a null id, lie in no container. Repeated ids are separate items. container_id is unique within the result.
    """
    spark = items.sparkSession
    limits = np.array([capacity, most_segments or capacity, most_loss or capacity], dtype=np.int64)
    kind = items.schema[ident].dataType.simpleString()
    cols = [ident, "piece_no", "start_token", "n_tokens", "n_loss", "container_id"]
    check_names(*cols, "is_open")
    schema = f"`{ident}` {kind}, piece_no int, start_token long, n_tokens long, n_loss long, container_id long, is_open boolean"
    valid = items.where(F.col(ident).isNotNull() & (F.col(size) > 0)).select(F.col(ident), F.col(size).cast("long").alias("__n"), F.greatest(F.coalesce(F.col(loss) if loss else F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("__l"))
    rest = F.pmod(F.col("__n"), F.lit(capacity))
    first = valid.agg(F.count(F.lit(1)).alias("items"), F.min(F.when(rest > 0, rest)).alias("least")).first()

    def cut(t: pa.Table) -> list[np.ndarray]:
        """(row, piece, start, tokens, loss) of all pieces."""
        n, l = t["__n"].to_numpy(), t["__l"].to_numpy()
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * capacity
        tokens = np.minimum(capacity, n[row] - start)
        return [row, piece, start, tokens, np.minimum(np.where(parts[row] == 1, l[row], -(-l[row] * tokens // n[row])), limits[2])]

    def place(level: int, least: int):
        """Pack the items of a task; a container that cannot take `least` more tokens, the smallest item anywhere, is closed."""

        def loose(used: np.ndarray) -> np.ndarray:
            return (used[:, 0] < CLOSED * capacity) & (used[:, 0] + least <= capacity) & (used[:, 1] < limits[1])

        def run(batches):
            from pyspark import TaskContext

            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            if level:
                row = np.arange(t.num_rows)
                piece, start, tokens, loss_ = (t[c].to_numpy() for c in ("piece_no", "start_token", "n_tokens", "n_loss"))
            else:
                row, piece, start, tokens, loss_ = cut(t)
            demand = np.stack([tokens, np.ones(len(tokens), dtype=np.int64), loss_], axis=1)
            base = (level << 56) | (TaskContext.get().partitionId() << 32)
            where = np.full(len(row), -1, dtype=np.int64)
            opened = np.zeros(len(row), dtype=bool)
            whole = np.flatnonzero(tokens == capacity)
            where[whole] = np.arange(len(whole))
            used = len(whole)
            rest = np.flatnonzero(tokens < capacity)
            carried = np.zeros(0, dtype=np.int64)
            blocks = max(1, -(-len(rest) // BLOCK))
            for i in range(blocks):  # each block a like mixture; what stays too empty goes on to the next
                now = np.concatenate([carried, rest[i::blocks]])
                if not len(now):
                    break
                container = fill(demand[now], limits)
                sums = _totals(container, demand[now])
                again = loose(sums)
                if i < blocks - 1:  # the emptiest go on, BLOCK items at most
                    by_fill = np.argsort(sums[:, 0], kind="stable")
                    by_fill = by_fill[again[by_fill]]
                    go = np.zeros(len(sums), dtype=bool)
                    go[by_fill[np.cumsum(sums[by_fill, 1]) <= BLOCK]] = True
                    carried = now[go[container]]
                    keep = ~go[container]
                else:
                    keep = np.ones(len(now), dtype=bool)
                numbers, compact = np.unique(container[keep], return_inverse=True)
                where[now[keep]] = used + compact
                opened[now[keep]] = again[container[keep]]
                used += len(numbers)
            out = [t[ident].take(pa.array(row)).combine_chunks(), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(tokens), pa.array(loss_), pa.array(base | where), pa.array(opened)]
            yield from pa.Table.from_arrays(out, names=[*cols, "is_open"]).to_batches(max_chunksize=10_000)

        return run

    now, count, least = valid, first["items"], first["least"] or 1
    tasks = tasks or max(min(parallelism(spark), math.ceil(count / 4_000)), math.ceil(count / ITEMS_PER_TASK), 1)
    done, level, before = None, 0, None
    while True:
        placed = materialize(now.repartition(tasks).mapInArrow(place(level, least), schema))
        left = placed.where("is_open").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("container_id").alias("containers"), F.min("n_tokens").alias("least")).first()
        gained = before is None or left["containers"] < (1 - GAIN) * before
        if tasks == 1 or not left["items"] or not gained:  # what is open stays as it is
            last = placed.drop("is_open")
            return last if done is None else done.unionByName(last)
        closed = placed.where(~F.col("is_open")).drop("is_open")
        done = closed if done is None else done.unionByName(closed)
        now = placed.where("is_open").drop("is_open", "container_id")
        before, least, count = left["containers"], left["least"], left["items"]
        tasks = max(1, math.ceil(count / ITEMS_PER_TASK))
        level += 1
