"""Row transforms and placement: from rows to boxes on a canvas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = 2147483647.0
BOX = ["cx", "cy", "minx", "miny", "maxx", "maxy"]


@dataclass(frozen=True)
class Placement:
    """Each part is 'col:<name>', 'con:<number>' or 'full'; one 'full' makes all four full."""

    centroid_x: str
    centroid_y: str
    width: str
    height: str

    def __post_init__(self):
        for p in self.parts():
            if p != "full" and not p.startswith(("col:", "con:")):
                raise ValueError(f"bad placement {p!r}")
            if p.startswith("con:"):
                float(p[4:])

    def parts(self) -> tuple[str, str, str, str]:
        return (self.centroid_x, self.centroid_y, self.width, self.height)

    @property
    def is_full(self) -> bool:
        return "full" in self.parts()

    def columns(self) -> list[str]:
        return [p[4:] for p in self.parts() if p.startswith("col:")]


def _value(part: str) -> Column:
    return F.col(part[4:]).cast("double") if part.startswith("col:") else F.lit(float(part[4:]))


def place(df: DataFrame, placement: Placement | None, static: bool = False) -> DataFrame:
    """Add cx, cy, minx, miny, maxx, maxy. Static layers get zeros; full ones cover every viewport."""
    if static or placement is None:
        return df.withColumns({c: F.lit(0.0) for c in BOX})
    if placement.is_full:
        return df.withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0), "minx": F.lit(-FULL / 2), "miny": F.lit(-FULL / 2), "maxx": F.lit(FULL / 2), "maxy": F.lit(FULL / 2)})
    x, y, w, h = (_value(p) for p in placement.parts())
    return df.withColumns({"cx": x, "cy": y, "minx": x - w / 2, "miny": y - h / 2, "maxx": x + w / 2, "maxy": y + h / 2})


def canvas_position(v: Column, lo: float, hi: float, top: int, mark: int, zoom: float, level: int) -> Column:
    """Position on a pyramid level of a value in [lo, hi] (reversed extents are legal), marks kept inside the canvas."""
    if lo == hi:
        raise ValueError("the extent of a pyramid axis is empty")
    return (F.lit(float(top - mark)) * (v.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) + F.lit(mark / 2)) * F.lit(float(zoom) ** level)


def project_layer(df: DataFrame, columns: list[str], extra: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Declared columns, extras such as cluster_agg, and the six box columns, in this order."""
    names = [*columns, *(extra or []), *BOX]
    return df.select(*[F.col(c).alias(prefix + c) for c in names])


def wire_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON dictionary a row for a client: null texts are '', missing boxes '0'."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    boxes = [F.coalesce(F.col(c).cast("string"), F.lit("0")).alias(c) if c in df.columns else F.lit("0").alias(c) for c in BOX]
    return df.select(F.to_json(F.struct(*cells, *boxes)).alias("row"))
