"""Viewport queries over placed layers: boxes, deltas, tiles, grids, slabs, strips and KD leaves.

Boxes are four double columns; every test is on closed intervals. Layers are written by operators.layouts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 1024
CELL = 1000
BOX_COLUMNS = ("cx", "cy", "minx", "miny", "maxx", "maxy")


@dataclass(frozen=True)
class Box:
    minx: float
    miny: float
    maxx: float
    maxy: float

    @property
    def width(self) -> float:
        return self.maxx - self.minx

    @property
    def height(self) -> float:
        return self.maxy - self.miny

    def wkt(self) -> str:
        a, b, c, d = self.minx, self.miny, self.maxx, self.maxy
        return f"POLYGON(({a} {b},{c} {b},{c} {d},{a} {d},{a} {b}))"

    def csv(self) -> str:
        return f"{self.minx},{self.miny},{self.maxx},{self.maxy}"


def overlaps(b: Box, prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return (c("maxx") >= b.minx) & (c("minx") <= b.maxx) & (c("maxy") >= b.miny) & (c("miny") <= b.maxy)


def in_box(df: DataFrame, b: Box) -> DataFrame:
    return df.where(overlaps(b))


def delta_exclude(df: DataFrame, new: Box, old: Box | None) -> DataFrame:
    """Rows of the new box that do not touch the old one."""
    return in_box(df, new) if old is None or old.width <= 0 else df.where(overlaps(new) & ~overlaps(old))


def difference(new: Box, old: Box) -> list[Box]:
    """New minus old as at most four rectangles."""
    if old.minx > new.maxx or old.maxx < new.minx or old.miny > new.maxy or old.maxy < new.miny:
        return [new]
    x0, x1 = max(new.minx, old.minx), min(new.maxx, old.maxx)
    out = []
    if new.minx < x0:
        out.append(Box(new.minx, new.miny, x0, new.maxy))
    if x1 < new.maxx:
        out.append(Box(x1, new.miny, new.maxx, new.maxy))
    if new.miny < old.miny:
        out.append(Box(x0, new.miny, x1, old.miny))
    if old.maxy < new.maxy:
        out.append(Box(x0, old.maxy, x1, new.maxy))
    return out


def delta_region(df: DataFrame, new: Box, old: Box | None) -> DataFrame:
    """Rows that touch the region new minus old; straddlers of the old box come again."""
    if old is None or old.width <= 0:
        return in_box(df, new)
    cond = F.lit(False)
    for b in difference(new, old):
        cond = cond | overlaps(b)
    return df.where(cond)


def centers_in_box(df: DataFrame, b: Box, mark_w: int, mark_h: int, old: Box | None = None) -> DataFrame:
    """Centre tests with the box grown by half a mark; the delta form leaves out what the old box, shrunk alike, has."""
    hw, hh = mark_w // 2, mark_h // 2
    cond = F.col("cx").between(b.minx - hw, b.maxx + hw) & F.col("cy").between(b.miny - hh, b.maxy + hh)
    if old is not None and old.width > 0:
        cond = cond & ~(F.col("cx").between(old.minx + hw, old.maxx - hw) & F.col("cy").between(old.miny + hh, old.maxy - hh))
    return df.where(cond)


def dynamic_box(mx: float, my: float, vw: float, vh: float, cw: float, ch: float) -> Box:
    """The box fetched for a viewport at (mx, my): twice its size, kept near the canvas."""
    x0, y0 = max(-10.0, mx - vw / 2), max(-10.0, my - vh / 2)
    return Box(x0, y0, min(cw + 10.0, x0 + 2 * vw), min(ch + 10.0, y0 + 2 * vh))


def needs_fetch(vx: float, vy: float, vw: float, vh: float, box: Box | None, cw: float, ch: float) -> bool:
    """Whether the viewport has come within a third of its size of an edge of the box that is not the canvas' own."""
    if box is None:
        return True
    return (
        (vx - box.minx < vw / 3 and box.minx > 0)
        or (vy - box.miny < vh / 3 and box.miny > 0)
        or (box.maxx - (vx + vw) < vw / 3 and box.maxx < cw)
        or (box.maxy - (vy + vh) < vh / 3 and box.maxy < ch)
    )


def incremental(new: DataFrame, held: DataFrame, b: Box) -> DataFrame:
    """Client state after a delta fetch: new rows, which do not touch the box held before, and held rows that touch the new one; disjoint."""
    return new.unionByName(in_box(held, b))


# tiles


def assign_tiles(df: DataFrame, side: int = TILE) -> DataFrame:
    """One row for each tile that a box touches; tiles start at 0, the upper edge included."""
    s = F.lit(float(side))
    lo = lambda c: F.greatest(F.lit(0).cast("long"), F.floor(F.col(c) / s))
    hi = lambda c: F.floor(F.col(c) / s)
    ok = df.where((hi("maxx") >= 0) & (hi("maxy") >= 0))
    return ok.withColumn("tile_x", F.explode(F.sequence(lo("minx"), hi("maxx")))).withColumn("tile_y", F.explode(F.sequence(lo("miny"), hi("maxy"))))


def viewport_tiles(vx: float, vy: float, vw: float, vh: float, cw: float, ch: float, side: int = TILE, extra: int = 0) -> list[tuple[int, int]]:
    """Tiles that a viewport shows, clipped to the canvas."""
    x0, y0 = max(0, int(vx // side) - extra), max(0, int(vy // side) - extra)
    x1 = min(int((vx + vw) // side) + extra, int(cw // side))
    y1 = min(int((vy + vh) // side) + extra, int(ch // side))
    return [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]


def check_tile(x: int, y: int, side: int = TILE) -> tuple[int, int]:
    """Tile numbers of a tile origin; origins off the raster are refused."""
    if x % side or y % side or x < 0 or y < 0:
        raise ValueError(f"a tile starts at multiples of {side}")
    return x // side, y // side


def fetch_tiles(tiled: DataFrame, tiles: list[tuple[int, int]]) -> DataFrame:
    """Rows of several tiles, each once."""
    cond = F.lit(False)
    for x, y in tiles:
        cond = cond | ((F.col("tile_x") == x) & (F.col("tile_y") == y))
    return tiled.where(cond).drop("tile_x", "tile_y").dropDuplicates()


def tile_index(df: DataFrame, keys: list[str], side: int = TILE) -> DataFrame:
    """The side table (keys..., tile_x, tile_y) of the join layout; keys tell the rows apart."""
    return assign_tiles(df.select(*keys, "minx", "miny", "maxx", "maxy"), side).select(*keys, "tile_x", "tile_y")


def fetch_by_index(df: DataFrame, index: DataFrame, keys: list[str], x: int, y: int) -> DataFrame:
    """Rows of a tile through the side table; Spark broadcasts the tile's keys where their size allows."""
    return df.join(index.where((F.col("tile_x") == x) & (F.col("tile_y") == y)).select(*keys), keys, "left_semi")


# other layouts


def pack_grid(df: DataFrame, columns: list[str], cell: int = CELL) -> DataFrame:
    """(grid_x, grid_y, rows, n, minx..maxy): rows packed by the cell of their centre, truncated toward 0.

    Cells are split into parts of 4096 rows by a hash, so that a crowded cell is no single huge row.
    """
    g = lambda c: (F.col(c).cast("long") / cell).cast("long")
    box = ["minx", "miny", "maxx", "maxy"]
    counted = df.withColumns({"grid_x": g("cx"), "grid_y": g("cy")})
    sizes = counted.groupBy("grid_x", "grid_y").agg(F.ceil(F.count(F.lit(1)) / 4096).alias("__parts"))
    parted = counted.join(sizes, ["grid_x", "grid_y"]).withColumn("part", F.pmod(F.xxhash64(*columns), F.col("__parts")).cast("int"))
    return parted.groupBy("grid_x", "grid_y", "part").agg(
        F.collect_list(F.struct(*dict.fromkeys([*columns, "cx", "cy", *box]))).alias("rows"), F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )


def unpack_grid(packed: DataFrame, b: Box) -> DataFrame:
    """Rows of the cells that touch the box, refined to the rows that do."""
    return in_box(packed.where(overlaps(b)).select(F.explode("rows").alias("r")).select("r.*"), b)


def as_slab(df: DataFrame, canvas: int) -> DataFrame:
    """A layer's rows for the one table of all canvases."""
    return df.withColumn("canvas_idx", F.lit(canvas))


def in_slab(df: DataFrame, canvas: int, b: Box) -> DataFrame:
    return df.where((F.col("canvas_idx") == canvas) & overlaps(b))


def x_strips(df: DataFrame, canvas_w: int, strips: int = 50) -> DataFrame:
    """Strip number by centre, for a partition column."""
    width = canvas_w / strips
    return df.withColumn("strip", F.greatest(F.lit(0), F.least(F.lit(strips - 1), F.floor(F.col("cx") / F.lit(width)).cast("int"))))


def in_strips(df: DataFrame, b: Box, canvas_w: int, half_width: float, strips: int = 50) -> DataFrame:
    """Only strips that can hold an overlapping box (padded by the widest half width), then the exact test."""
    width = canvas_w / strips
    lo = max(0, min(strips - 1, int((b.minx - half_width) // width)))
    hi = max(0, min(strips - 1, int((b.maxx + half_width) // width)))
    return df.where(F.col("strip").between(lo, hi) & overlaps(b))


def kd_splits(df: DataFrame, leaves: int = 4, column: str = "cx", accuracy: int = 10_000) -> list[float]:
    """Split points that balance the leaves: quantiles of the column (vertical splits), rank error 1/accuracy."""
    shares = [i / leaves for i in range(1, leaves)]
    got = df.agg(F.percentile_approx(column, shares, accuracy).alias("q")).first()["q"]
    return sorted({float(v) for v in got or []})


def kd_leaf(v: Column, splits: list[float]) -> Column:
    """Leaf number; bounds are closed and the left leaf goes first, so a value on a split lies left of it."""
    out = F.lit(len(splits))
    for i in range(len(splits) - 1, -1, -1):
        out = F.when(v <= F.lit(splits[i]), F.lit(i)).otherwise(out)
    return out


def by_leaf(df: DataFrame, splits: list[float], column: str = "cx") -> DataFrame:
    """Rows with their leaf number, each leaf in a partition of its own."""
    return df.withColumn("leaf", kd_leaf(F.col(column), splits)).repartitionById(len(splits) + 1, F.col("leaf"))


def kd_route(splits: list[float], b: Box, pad: float = 0.0) -> list[int]:
    """Leaves that a box touches."""
    edges = [float("-inf"), *splits, float("inf")]
    return [i for i in range(len(edges) - 1) if edges[i] <= b.maxx + pad and edges[i + 1] >= b.minx - pad]


def z_order(x: Column, y: Column, extent: Box, bits: int = 12) -> Column:
    """Morton code of a position, for sorting written layers."""
    top = (1 << bits) - 1
    q = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / max(hi - lo, 1e-9) * top), F.lit(0)), F.lit(top)).cast("long")
    a, b = q(x, extent.minx, extent.maxx), q(y, extent.miny, extent.maxy)
    code = F.lit(0).cast("long")
    for i in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(a, i).bitwiseAND(F.lit(1).cast("long")), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(b, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + 1))
    return code
