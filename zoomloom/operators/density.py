"""Density kernels: weighted 2-D histograms with a Gaussian blur, contour bands and lines, and heat-map intensities."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def density_grid(df: DataFrame, x: str, y: str, weight: Column, cell: float = 2.0) -> DataFrame:
    """(cell_x, cell_y, weight): sums by cell, combined before the shuffle."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) / cell).alias("cell_x"), F.floor(F.col(y) / cell).alias("cell_y")).agg(F.sum(weight).alias("weight"))


def blur(grid: DataFrame, bandwidth_cells: float) -> DataFrame:
    """Separable Gaussian blur of a grid: two passes of a short explode and a sum."""
    reach = max(1, math.ceil(3 * bandwidth_cells))
    raw = [math.exp(-0.5 * (i / bandwidth_cells) ** 2) for i in range(-reach, reach + 1)]
    taps = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(v / sum(raw)).alias("k")) for i, v in zip(range(-reach, reach + 1), raw)])

    def pass_over(g: DataFrame, axis: str) -> DataFrame:
        moved = g.withColumn("t", F.explode(taps)).withColumns({axis: F.col(axis) + F.col("t.d"), "weight": F.col("weight") * F.col("t.k")})
        return moved.groupBy("cell_x", "cell_y").agg(F.sum("weight").alias("weight"))

    return pass_over(pass_over(grid, "cell_x"), "cell_y")


def contour_thresholds(rough_n: int, level: int, steps: int = 6) -> list[float]:
    """Levels of density contours from the number of clusters."""
    top = 0.07 * rough_n / 1000 / 2.4**level
    out, v = [], 1e-4
    while top > 0 and v < top:
        out.append(v)
        v += top / steps
    return out


def contour_band(grid: DataFrame, thresholds: list[float]) -> DataFrame:
    """Band of each cell: how many thresholds its density reaches."""
    total = F.lit(0)
    for t in thresholds:
        total = total + F.when(F.col("weight") >= t, 1).otherwise(0)
    return grid.withColumn("band", total)


def contour_lines(grid: DataFrame, thresholds: list[float], cell: float = 1.0) -> DataFrame:
    """(threshold, x0, y0, x1, y1): the pieces of the lines along which the density of a grid (cell_x, cell_y, weight) equals each threshold.

    Marching squares: every square between four cell centres adds the piece that crosses it, linear between the centres; cells that are not there have
    density 0. Where two opposite corners are above, the mean of the four tells which are joined. Higher densities lie to the left.
    """
    corners = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(2 * dy + dx).alias("at")) for dx in (0, 1) for dy in (0, 1)])
    near = grid.withColumn("c", F.explode(corners)).groupBy((F.col("cell_x") + F.col("c.dx")).alias("sx"), (F.col("cell_y") + F.col("c.dy")).alias("sy"))
    squares = near.agg(*[F.coalesce(F.sum(F.when(F.col("c.at") == i, F.col("weight"))), F.lit(0.0)).cast("double").alias(f"w{i}") for i in range(4)])

    def march(batches):
        for b in batches:
            sx, sy, w00, w10, w01, w11 = (b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(6))
            for t in thresholds:
                # corners counter-clockwise, edges between them: 0 bottom, 1 right, 2 top, 3 left
                w = np.stack([w00, w10, w11, w01])
                up = w >= t
                at = np.flatnonzero(up.any(0) & ~up.all(0))
                if not len(at):
                    continue
                v, u = w[:, at], up[:, at]
                nxt = np.roll(v, -1, axis=0)
                part = np.divide(t - v, nxt - v, out=np.full(v.shape, 0.5), where=nxt != v)
                ex = np.stack([part[0], np.ones(len(at)), 1 - part[2], np.zeros(len(at))]) + sx[at] + 0.5
                ey = np.stack([np.zeros(len(at)), part[1], np.ones(len(at)), 1 - part[3]]) + sy[at] + 0.5
                leaves, enters = u & ~np.roll(u, -1, axis=0), ~u & np.roll(u, -1, axis=0)  # edges where the way round goes down, and up
                full = v.mean(0) >= t
                for e in range(4):
                    own = np.flatnonzero(leaves[e])
                    saddle = leaves[:, own].sum(0) == 2
                    # the line that leaves the high side here comes back at the edge before (joined corners) or after (corners apart)
                    back = np.where(saddle, np.where(full[own], (e + 1) % 4, (e + 3) % 4), enters[:, own].argmax(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), float(t))), *[pa.array(c * cell) for c in (ex[e, own], ey[e, own], ex[back, own], ey[back, own])]], names=["threshold", "x0", "y0", "x1", "y1"])

    return squares.select("sx", "sy", "w0", "w1", "w2", "w3").mapInArrow(march, "threshold double, x0 double, y0 double, x1 double, y1 double")


def heat_alpha(w: Column, lo: Column, hi: Column) -> Column:
    """Opacity of a mark: its place between least and greatest weight, 0.01 at least, 1 at most."""
    part = F.when(hi > lo, (w - lo) / F.nullif(hi - lo, F.lit(0))).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), part.cast("double")))


def heat_grid(points: DataFrame, radius_cells: int) -> DataFrame:
    """Intensity of cells: each point (cell_x, cell_y, alpha) adds alpha, fading linearly to 0 at the radius; sums are capped at 1."""
    r = radius_cells
    discs = [(dx, dy, 1 - math.hypot(dx, dy) / r) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if math.hypot(dx, dy) < r]
    taps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(k).alias("k")) for a, b, k in discs])
    per_cell = points.groupBy("cell_x", "cell_y").agg(F.sum("alpha").alias("alpha"))  # before exploding
    out = per_cell.withColumn("t", F.explode(taps)).groupBy((F.col("cell_x") + F.col("t.dx")).alias("cell_x"), (F.col("cell_y") + F.col("t.dy")).alias("cell_y")).agg(F.sum(F.col("alpha") * F.col("t.k")).alias("heat"))
    return out.withColumn("heat", F.least(F.lit(1.0), F.col("heat")))


def ramp_stop(v: Column) -> Column:
    """Segment of the colour ramp with stops 0, .25, .55, .85, 1."""
    return F.when(v < 0.25, 0).when(v < 0.55, 1).when(v < 0.85, 2).otherwise(3)
