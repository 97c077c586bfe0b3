"""Per-key comparison of records when a few keys hold most rows: fragment-replicate by estimated load.

Plan
1. One aggregation estimates the load of every key. Keys above a small part of a fair share are *large*: at most LARGE per
   task, so the driver may hold them. All other keys fall into hash buckets whose loads are added up.
2. A large key is cut into tiles of the (x, y) plane, as many as its load asks for; a second aggregation, over large keys only, counts the
   tiles' rows and, from an eighth of the records, the candidates that crowded spots in them make.
3. Buckets and tiles are bin-packed to tasks. A tile or bucket that still exceeds a fair share is cut into
   proportionate shards by a hash of the record id, and each pair of shards is a slot of its own.
4. Every row goes to the slots of its shard. The matching side, and only it, is replicated: to the slots of its tile, and to
   those of neighbouring tiles that its reach touches.
5. Each task finds its pairs on a grid with cells as wide as the reach. A pair comes out where the record
   with the greater id is at home, in the slot of both records' shards, so it comes out once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoomloom.operators.balance import expand_ranges, pack_pairs, pair_slots, task_count
from zoomloom.session import check_names, discard, materialize, parallelism

ROWS_PER_TASK = 400_000
BUCKETS_PER_TASK = 8
TILES_PER_SHARE = 16
CANDIDATES = 2_000_000
LARGE = 16  # keys above this part of a fair share are tiled
SPOTS = 8  # the part of the records that estimates candidates


def order_codes(column) -> np.ndarray:
    """Integers that sort as the values of the Arrow column do."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)


def grid_pairs(group, ident, x, y, home, reach_x: float, reach_y: float, cross=None):
    """Yield (a, b): indices of rows of one group at most the reaches apart, ident[a] < ident[b], home[b]; with `cross` (see pair_slots) only
    those that are to be compared. Rows that agree in group, ident, x and y count once. Candidates are made in blocks of bounded size.
    """
    if not len(group):
        return
    cell_x = np.floor(x / (reach_x or 1.0)).astype(np.int64)
    cell_y = np.floor(y / (reach_y or 1.0)).astype(np.int64)
    cell_x -= cell_x.min() - 1
    cell_y -= cell_y.min() - 1
    wide_x, wide_y = int(cell_x.max()) + 2, int(cell_y.max()) + 2
    ranks = np.unique(group, return_inverse=True)[1].astype(np.int64)
    if (int(ranks.max()) + 1) * wide_x * wide_y >= 2**62:  # too wide for one integer: number the cells that are there
        columns, column = np.unique(np.stack([ranks, cell_x]), axis=1, return_inverse=True)
        find = {tuple(c): i for i, c in enumerate(columns.T.tolist())}
        shifted = [np.array([find.get((g, c + d), -1) for g, c in columns.T.tolist()], dtype=np.int64)[column.ravel()] for d in (-1, 0, 1)]
        base = [np.where(s >= 0, s * wide_y, -(2**62)) for s in shifted]
        code = column.ravel().astype(np.int64) * wide_y + cell_y
    else:
        code = (ranks * wide_x + cell_x) * wide_y + cell_y
        base = [(ranks * wide_x + cell_x + d) * wide_y for d in (-1, 0, 1)]
    order = np.lexsort((y, x, ident, code))
    same = np.ones(len(order), dtype=bool)
    same[0] = False
    for c in (code, ident, x, y):
        same[1:] &= c[order[1:]] == c[order[:-1]]
    order = order[~same]
    codes = code[order]
    probes = order[home[order]]
    for b in base:
        lo = np.searchsorted(codes, b[probes] + cell_y[probes] - 1, "left")
        hi = np.searchsorted(codes, b[probes] + cell_y[probes] + 1, "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(probes):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
            for part in range(int(lo[at]), int(hi[at]), CANDIDATES) if stop == at + 1 else [None]:
                if part is None:
                    owner, index = expand_ranges(lo[at:stop], hi[at:stop])
                else:  # one probe with very many candidates
                    index = np.arange(part, min(part + CANDIDATES, int(hi[at])))
                    owner = np.zeros(len(index), dtype=np.int64)
                q, p = probes[at:stop][owner], order[index]
                keep = (ident[p] < ident[q]) & (np.abs(x[p] - x[q]) <= reach_x) & (np.abs(y[p] - y[q]) <= reach_y)
                if cross is not None:
                    keep &= (cross[p] < 0) | (cross[p] != cross[q])
                if keep.any():
                    yield p[keep], q[keep]
            at = stop


def near_pairs_by_key(
    df: DataFrame,
    key: str,
    ident: str,
    x: str,
    y: str,
    reach_x: float,
    reach_y: float,
    extent: tuple[float, float, float, float],
    tasks: int | None = None,
) -> DataFrame:
    """Pairs of records of one key whose x differ by at most reach_x and y by at most reach_y.

    Result: (key, id_a, id_b), id_a < id_b, once each. Rows with a null key, id, x or y, a NaN, or a
    position outside the closed extent (x0, y0, x1, y1) take no part. Rows repeated unchanged are one record; two
    records of one id never form a pair. Ids are integers or strings; other columns of df are ignored.
    An empty table gives an empty result.
    """
    check_names(key, "id_a", "id_b")
    spark = df.sparkSession
    x0, y0, x1, y1 = extent
    types = {f.name: f.dataType for f in df.schema.fields}
    clean = df.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("k").isNotNull() & F.col("i").isNotNull() & F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    )
    sizes = materialize(clean.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = tasks or task_count(total, parallelism(spark), ROWS_PER_TASK)
    share = max(1.0, total / tasks)
    buckets = tasks * BUCKETS_PER_TASK
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")

    # Loads: one row per large key (fewer than LARGE per task) and one per bucket of the other keys.
    large = F.col("n") > share / LARGE
    loads = (
        sizes.groupBy(F.when(large, F.col("k")).alias("k"), F.when(~large, bucket).alias("bucket"))
        .agg(F.sum("n").alias("n")).collect()
    )
    bucket_loads = np.zeros(buckets)
    big = []
    for r in loads:
        if r["k"] is None:
            bucket_loads[r["bucket"]] = r["n"]
        else:
            big.append((r["k"], r["n"], max(1, math.ceil(math.sqrt(TILES_PER_SHARE * r["n"] / share)))))
    big.sort(key=lambda r: str(r[0]))
    side_x, side_y = max(x1 - x0, 1e-9), max(y1 - y0, 1e-9)
    discard(sizes)
    sides, first_tile, tile_n, tile_rows = [], [], [], []
    for k, n, g in big:
        gx = max(1, min(g, int(side_x // max(4 * reach_x, 1e-9)))) if reach_x else g
        gy = max(1, min(g, int(side_y // max(4 * reach_y, 1e-9)))) if reach_y else g
        sides.append((gx, gy))
        first_tile.append(len(tile_n))
        tile_n.extend([0.0] * (gx * gy))
        tile_rows.extend([0.0] * (gx * gy))
    if big:
        kt = types[key]
        grid = spark.createDataFrame([(k, i, gx, gy) for i, ((k, _, _), (gx, gy)) in enumerate(zip(big, sides))], T.StructType([T.StructField("k", kt), T.StructField("ki", T.IntegerType()), T.StructField("gx", T.IntegerType()), T.StructField("gy", T.IntegerType())]))
        # F.broadcast: fewer than LARGE rows a task, see above. A spot is four reaches wide.
        spot = [F.floor(F.col(c) / F.lit(4.0 * (r or 0.25))) for c, r in (("x", reach_x), ("y", reach_y))]
        tile = [F.least(F.floor((F.col(c) - lo) / side * F.col(g)), F.col(g) - 1).cast("int").alias(t) for c, lo, side, g, t in (("x", x0, side_x, "gx", "tx"), ("y", y0, side_y, "gy", "ty"))]
        seen = F.pmod(F.xxhash64("i"), F.lit(SPOTS)) == 0
        placed = clean.join(F.broadcast(grid), "k").select("ki", *tile, *[F.when(seen, c).alias(n) for c, n in zip(spot, ("sx", "sy"))])
        counts = placed.groupBy("ki", "tx", "ty", "sx", "sy").agg(F.count(F.lit(1)).alias("s"))  # the records not seen are one row a tile
        # of s records seen at a spot, s (s - 1) pairs; a record's candidates lie in 9 of the 16 cells of a spot
        pairs_ = F.sum(F.when(F.col("sx").isNotNull(), F.col("s") * (F.col("s") - 1))) * (SPOTS * SPOTS * 9 / 16)
        for r in counts.groupBy("ki", "tx", "ty").agg(F.sum("s").alias("n"), pairs_.alias("c")).collect():
            gx, gy = sides[r["ki"]]
            at = first_tile[r["ki"]] + r["tx"] * gy + r["ty"]
            tile_rows[at] = r["n"]
            tile_n[at] = r["n"] + (r["c"] or 0.0)
    shards, first, bins = pack_pairs(np.concatenate([bucket_loads, np.array(tile_n)]), np.concatenate([bucket_loads, np.array(tile_rows)]), tasks, 2 * ROWS_PER_TASK)

    big_keys = pa.array([b[0] for b in big]) if big else None
    gxs = np.array([s[0] for s in sides], dtype=np.int64)
    gys = np.array([s[1] for s in sides], dtype=np.int64)
    starts = np.array(first_tile, dtype=np.int64) + buckets

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            xs, ys = t["x"].to_numpy(), t["y"].to_numpy()
            unit = t["bucket"].to_numpy().astype(np.int64)
            split = t["split"].to_numpy()
            rows = np.arange(len(unit))
            far_row, far_unit = [], []
            if big_keys is not None:
                ki = pc.fill_null(pc.index_in(t["k"], value_set=big_keys.cast(t["k"].type)), -1).to_numpy().astype(np.int64)
                at = np.flatnonzero(ki >= 0)
                kb, px, py = ki[at], (xs[at] - x0) / side_x, (ys[at] - y0) / side_y
                gx, gy = gxs[kb], gys[kb]

                def tile(fx, fy):
                    tx = np.clip(np.floor(fx * gx), 0, gx - 1).astype(np.int64)
                    ty = np.clip(np.floor(fy * gy), 0, gy - 1).astype(np.int64)
                    return starts[kb] + tx * gy + ty

                own = tile(px, py)
                unit[at] = own
                seen = [own]
                # a tile is at least four reaches wide, so the corners of the reach touch all tiles it touches
                for dx in (-reach_x, reach_x):
                    for dy in (-reach_y, reach_y):
                        other = tile(px + dx * (1 + 1e-9) / side_x, py + dy * (1 + 1e-9) / side_y)
                        new = np.all([other != s for s in seen], axis=0)
                        far_row.append(at[new])
                        far_unit.append(other[new])
                        seen.append(other)
            # the home tile of each row, then those that its reach touches; all slots of its shard there
            r2, u2 = np.concatenate([rows, *far_row]), np.concatenate([unit, *far_unit])
            h2 = np.arange(len(r2)) < len(rows)
            at, slot, cross = pair_slots((split[r2] % shards[u2]).astype(np.int64), shards[u2])
            r2, u2, h2 = r2[at], u2[at], h2[at]
            slot = first[u2] + slot
            out = t.select(["k", "i", "x", "y"]).take(pa.array(r2))
            out = out.append_column("home", pa.array(h2)).append_column("cross", pa.array(cross)).append_column("slot", pa.array(slot.astype(np.int32))).append_column("bin", pa.array(bins[slot]))
            yield from out.to_batches()

    def pairs(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        keys = np.unique(t["k"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) * (len(bins) + 1) + t["slot"].to_numpy(), return_inverse=True)[1]
        ident = order_codes(t["i"])
        for a, b in grid_pairs(keys, ident, t["x"].to_numpy(), t["y"].to_numpy(), t["home"].to_numpy(zero_copy_only=False), reach_x, reach_y, t["cross"].to_numpy()):
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in (t["k"].take(pa.array(b)), t["i"].take(pa.array(a)), t["i"].take(pa.array(b)))], names=[key, "id_a", "id_b"])

    kt, it = types[key], types[ident]
    routed = clean.withColumn("bucket", bucket).withColumn("split", F.xxhash64("i").bitwiseAND(F.lit(0x7FFFFFFF))).mapInArrow(
        route, T.StructType([T.StructField("k", kt), T.StructField("i", it), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("home", T.BooleanType()), T.StructField("cross", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("bin", T.IntegerType())])
    )
    return routed.repartitionById(tasks, F.col("bin")).mapInArrow(pairs, T.StructType([T.StructField(key, kt), T.StructField("id_a", it), T.StructField("id_b", it)]))
