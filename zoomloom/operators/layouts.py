"""Layers written for viewport queries, in one of five layouts, and the same queries over each.

box    rows sorted along a Z-order of their centres
tile   one row for each tile a box touches, sorted by tile; `home` marks one copy of each row
grid   rows packed by cell, one list a part of a cell
strip  rows sorted by vertical strip, then along the Z-order
slab   rows of all layers of a canvas set in one table, sorted by canvas, then along the Z-order

Everything is a plain Parquet table with a manifest. Queries are comparisons of stored columns with numbers, so they reach the scan, and row groups
and pages outside are skipped by their least and greatest values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.operators import viewport
from zoomloom.operators.viewport import Box
from zoomloom.sources import manifest

LAYOUTS = ("box", "tile", "grid", "strip", "slab")
ROWS_PER_FILE = 500_000
STRIPS = 50


def write(df: DataFrame, path: str, extent: Box, layout: str = "box", side: int | None = None, canvas: int = 0) -> None:
    """Write placed rows (with cx, cy and the box) as a layer. Replaces what is there. Files follow the number of rows.

    A slab takes rows of several canvases that carry their canvas_idx, or those of one, `canvas`.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    side = side or (viewport.CELL if layout == "grid" else viewport.TILE)
    told = {"layout": layout, "side": side, "canvas": canvas, "width": extent.width}
    z = viewport.z_order(F.col("cx"), F.col("cy"), extent, 16)
    columns = df.columns
    if layout == "tile":
        rows = viewport.assign_tiles(df, side)
        lo = lambda c: F.greatest(F.lit(0).cast("long"), F.floor(F.col(c) / float(side)))
        rows = rows.withColumn("home", (F.col("tile_x") == lo("minx")) & (F.col("tile_y") == lo("miny")))
        keys = [F.col("tile_x"), F.col("tile_y")]
    elif layout == "grid":
        rows, keys = viewport.pack_grid(df, [c for c in columns if c not in viewport.BOX_COLUMNS], side), [F.col("grid_x"), F.col("grid_y"), F.col("part")]
    elif layout == "strip":
        rows = viewport.x_strips(df, extent.width, STRIPS)
        told["half"] = float(df.agg(F.max((F.col("maxx") - F.col("minx")) / 2)).first()[0] or 0.0)
        keys = [F.col("strip"), z]
    elif layout == "slab":
        rows, keys = df if "canvas_idx" in columns else viewport.as_slab(df, canvas), [F.col("canvas_idx"), z]
    else:
        rows, keys = df, [z]
    files = max(1, math.ceil(df.count() / ROWS_PER_FILE))
    names = [f"__k{i}" for i in range(len(keys))]
    sorted_ = rows.withColumns(dict(zip(names, keys))).repartitionByRange(files, *names).sortWithinPartitions(*names).drop(*names)
    manifest.save_table(sorted_, path, **told)


class Written:
    """A written layer: its rows, those in a box, and those that a moved box adds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.told = manifest.manifest(spark, path)
        if self.told is None:
            raise FileNotFoundError(f"no layer in {path}")
        self.layout, self.side = self.told["layout"], self.told["side"]

    def exists(self) -> bool:
        return manifest.manifest(self.spark, self.path) is not None

    @property
    def stored(self) -> DataFrame:
        return manifest.read_table(self.spark, self.path, self.told)

    def rows(self) -> DataFrame:
        """Every row once."""
        t = self.stored
        if self.layout == "tile":
            return t.where("home").drop("tile_x", "tile_y", "home")
        if self.layout == "grid":
            return t.select(F.explode("rows").alias("r")).select("r.*")
        if self.layout == "slab":
            return t.where(F.col("canvas_idx") == self.told["canvas"]).drop("canvas_idx")
        return t.drop("strip")

    def in_box(self, b: Box, canvas: int | None = None) -> DataFrame:
        t = self.stored
        if self.layout == "grid":
            return viewport.unpack_grid(t, b)
        if self.layout == "strip":
            return viewport.in_strips(t, b, self.told["width"], self.told["half"], STRIPS).drop("strip")
        if self.layout == "slab":
            return viewport.in_slab(t, self.told["canvas"] if canvas is None else canvas, b).drop("canvas_idx")
        if self.layout == "tile":
            x0, y0 = (max(0, math.floor(v / self.side)) for v in (b.minx, b.miny))
            x1, y1 = (math.floor(v / self.side) for v in (b.maxx, b.maxy))
            lo = lambda c, least: F.greatest(F.lit(least).cast("long"), F.floor(F.col(c) / float(self.side)))
            near = t.where(F.col("tile_x").between(x0, x1) & F.col("tile_y").between(y0, y1) & viewport.overlaps(b))
            # of a row's copies in these tiles, the one in its first counts
            return near.where((F.col("tile_x") == lo("minx", x0)) & (F.col("tile_y") == lo("miny", y0))).drop("tile_x", "tile_y", "home")
        return viewport.in_box(t, b)

    def added(self, new: Box, old: Box | None) -> DataFrame:
        """Rows of the new box that do not touch the old one."""
        rows = self.in_box(new)
        return rows if old is None or old.width <= 0 else rows.where(~viewport.overlaps(old))

    def tile(self, x: int, y: int) -> DataFrame:
        """Rows of tile number (x, y): those whose box touches it, the upper edge included."""
        if self.layout == "tile":
            return self.stored.where((F.col("tile_x") == x) & (F.col("tile_y") == y)).drop("tile_x", "tile_y", "home")
        return self.in_box(Box(x * self.side, y * self.side, (x + 1) * self.side, (y + 1) * self.side))
