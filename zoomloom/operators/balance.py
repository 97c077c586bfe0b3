"""Bin-packing of estimated loads to tasks: the shared planner of the skew-proof joins.

The planner works on the driver on loads of *units* (keys, hash buckets, tiles, quadtree leaves), whose
number the callers bound by the number of tasks. It never sees rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


SLACK = 0.85  # a slot may be this much short of splitting a unit into fair shares, so that slots do not outnumber tasks


def longest_first(loads: np.ndarray, tasks: int) -> np.ndarray:
    """Task of each load: the heaviest first, always to the task that has least."""
    bins = np.zeros(len(loads), dtype=np.int32)
    heap = [(0.0, t) for t in range(tasks)]
    for i in np.argsort(-loads, kind="stable"):
        load, t = heapq.heappop(heap)
        bins[i] = t
        heapq.heappush(heap, (load + loads[i], t))
    return bins


def pack_units(loads, tasks: int) -> np.ndarray:
    """Task of each unit, for units that are never split."""
    return longest_first(np.maximum(np.asarray(loads, dtype=np.float64), 1.0), tasks)


def pack_pairs(loads, rows, tasks: int, most_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Divide units whose records are compared with each other: a unit above a fair share, or of more than most_rows records, is cut
    into shards, and each pair of shards (a shard with itself among them) is a slot of its own. So a task never sees more than two shards of a unit.

    Returns (shards, first, bins): unit u has shards[u] shards; the task of its slot s is bins[first[u] + s], with s from `pair_slots`.
    """
    loads, rows = np.maximum(np.asarray(loads, dtype=np.float64), 1.0), np.asarray(rows, dtype=np.float64)
    share = max(loads.sum() / max(tasks, 1), 1.0)
    shards = np.maximum(np.ceil((np.sqrt(8 * SLACK * loads / share + 1) - 1) / 2), np.where(rows > most_rows, np.ceil(2 * rows / most_rows), 1)).astype(np.int64)
    slots = shards * (shards + 1) // 2
    first = np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.int64) if len(slots) else np.zeros(0, np.int64)
    return shards, first, longest_first(np.repeat(loads / slots, slots), tasks)


def pair_slots(shard: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, cross) of all slots that a row of shard[row] out of shards[row] takes part in. cross is the row's shard, or -1 in the slot where
    its shard meets itself: two rows of a slot are to be compared if they have -1 or differ in it, so every pair of rows is compared once."""
    row, other = expand_ranges(np.zeros(len(shard), dtype=np.int64), shards)
    own = shard[row]
    low, high = np.minimum(own, other), np.maximum(own, other)
    return row, high * (high + 1) // 2 + low, np.where(own == other, -1, own)


def task_count(rows: int, slots: int, rows_per_task: int) -> int:
    """Tasks for so many rows: two waves of the cluster at least, else by rows."""
    return max(2 * slots, math.ceil(rows / rows_per_task))


def expand_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) of every index of the ranges [lo, hi)."""
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(lo)), n)
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n)
    return owner, start + np.arange(len(owner))
