"""Top N items of every group: sorted runs, merged by a loser tree that seeks to the next group after N outputs.

Plan
1. Every partition becomes one sorted run: rows ordered by (group, score terms). As no run can add more than N rows of
   a group to the result, a run keeps only the first N of each group; so a group of any size reaches a task
   as at most N rows a run.
2. Runs are stored in the shared folder and read by bucket, a hash of the group; the rows stored tell how many buckets there are.
3. Each bucket merges its runs with a loser tree. After N outputs of a group, each run that comes up with that group again seeks
   by binary search to its next group; rows in between are never compared, and runs without the group are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoomloom.operators.balance import task_count
from zoomloom.session import materialize, parallelism

_GROUP, _RUN, _BUCKET = "__group", "__run", "__bucket"
ROWS_PER_BUCKET = 200_000


class LoserTree:
    """Tournament of sorted runs. runs[i] is a sorted list of keys; keys are tuples whose first term is the group."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [-1] * self.k  # tree[0]: the winner; others: losers of the inner nodes
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; an exhausted run comes last, equal heads go by run number."""
        ra, rb = self.runs[a], self.runs[b]
        if self.at[a] >= len(ra):
            return False
        if self.at[b] >= len(rb):
            return True
        ha, hb = ra[self.at[a]], rb[self.at[b]]
        return ha < hb or (ha == hb and a < b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the tree is being filled: wait here for an opponent
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def merge(self, n: int):
        """Yield (run, position) of the first n of every group, in order."""
        group, out = None, 0
        while self.runs:
            w = self.tree[0]
            if self.at[w] >= len(self.runs[w]):
                return
            head = self.runs[w][self.at[w]]
            if head[0] != group:
                group, out = head[0], 0
            if out < n:
                yield w, self.at[w]
                out += 1
                self.at[w] += 1
                self._play(w)
            else:
                self.seek(w, group)

    def seek(self, i: int, group) -> None:
        """Move run i, the winner, past the group and let it play again."""
        run = self.runs[i]
        lo, step = self.at[i], 1
        while lo + step < len(run) and run[lo + step - 1][0] <= group:  # gallop, then bisect
            lo, step = lo + step, step * 2
        hi = min(lo + step, len(run))
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if run[mid][0] <= group else (lo, mid)
        self.at[i] = lo
        self._play(i)


def _ordered(t: pa.Table, order: list[tuple[str, str]]) -> pa.Array:
    return pc.sort_indices(t, sort_keys=[(_GROUP, "ascending")] + [(f"__o{i}", "ascending" if d == "asc" else "descending") for i, (_, d) in enumerate(order)], null_placement="at_end")


def top_n(df: DataFrame, group: str, order: list[tuple[str, str]], n: int, buckets: int | None = None) -> DataFrame:
    """The first n rows of every group by `order`, a list of (expression, 'asc' | 'desc'); strings compare by code point.

    The order should be total (end it with a unique column); rows that tie in all of it come out in no stated order,
    but n of them at most. Rows with a null group are left out; null scores come last either way. All columns of df
    come out, unchanged. Groups with fewer rows give all they have; an empty table gives an empty result.
    """
    keyed = df.where(F.col(group).isNotNull()).withColumns({_GROUP: F.col(group), **{f"__o{i}": F.expr(e) for i, (e, _) in enumerate(order)}})
    out_schema = df.schema
    run_schema = T.StructType(keyed.schema.fields + [T.StructField(_RUN, T.LongType())])

    def build(batches):
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []

        def cut(t: pa.Table) -> pa.Table:
            """Sorted, the first n of each group."""
            t = t.combine_chunks().take(_ordered(t, order))
            if not t.num_rows:
                return t
            codes = t[_GROUP].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            place = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
            return t.filter(pa.array(place < n))

        kept, rows = None, 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 200_000:  # what a run has so far is cut down before it goes on
                kept = cut(pa.Table.from_batches([*(kept.to_batches() if kept is not None else []), *held]))
                held, rows = [], 0
        if held or kept is not None:
            t = cut(pa.Table.from_batches([*(kept.to_batches() if kept is not None else []), *held]))
            t = t.set_column(t.schema.get_field_index(_RUN), _RUN, pa.array(np.full(t.num_rows, run, dtype=np.int64)))
            yield from t.to_batches(max_chunksize=10_000)

    def merge(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        # group and score terms become integers that sort as the values do, so the tree compares tuples of integers
        codes = []
        for name, d in [(_GROUP, "asc")] + [(f"__o{i}", d) for i, (_, d) in enumerate(order)]:
            rank = pc.rank(t[name].combine_chunks(), sort_keys="ascending" if d == "asc" else "descending", null_placement="at_end", tiebreaker="dense")
            codes.append(rank.to_numpy().astype(np.int64))
        runs = np.unique(t[_RUN].to_numpy(), return_inverse=True)[1]
        by = np.lexsort((*codes[::-1], runs))  # the shuffle may deliver a run in pieces
        cuts = np.searchsorted(runs[by], np.arange(int(runs.max()) + 2))
        keys = list(zip(*(c[by].tolist() for c in codes)))
        tree = LoserTree([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        picked = np.fromiter((cuts[r] + p for r, p in tree.merge(n)), dtype=np.int64)
        yield from t.select(out_schema.names).take(pa.array(by[picked])).to_batches(max_chunksize=10_000)

    stored = materialize(keyed.withColumn(_RUN, F.lit(0).cast("long")).mapInArrow(build, run_schema))
    buckets = buckets or task_count(stored.count(), parallelism(df.sparkSession), ROWS_PER_BUCKET)
    bucketed = stored.withColumn(_BUCKET, F.pmod(F.xxhash64(_GROUP), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col(_BUCKET))
    return bucketed.mapInArrow(merge, out_schema)
