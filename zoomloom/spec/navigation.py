"""Jumps and zooming as pure functions: predicates and viewports from a clicked row, factors, axis ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from zoomloom.spec.model import Jump, Project, View
from zoomloom.spec.predicates import Everything, Predicate, from_json, to_column


@dataclass(frozen=True)
class Target:
    """Where a jump leads: canvas, predicate of each layer, and the viewport's corner (None: keep)."""

    canvas: str
    predicates: tuple[Predicate, ...]
    corner: tuple[float, float] | None


def applicable(p: Project, canvas: str, row: dict, args: dict) -> list[Jump]:
    """Jumps that a clicked row offers."""
    return [j for j in p.jumps if j.source == canvas and (j.selector is None or j.selector(row, args))]


def jump_name(j: Jump, row: dict) -> str:
    """What a jump is called for a clicked row: its own text or function, else where it leads."""
    return str(j.name(row)) if callable(j.name) else j.name or f"{j.type} to {j.dest}"


def layer_predicates(p: Project, j: Jump, row: dict) -> tuple[Predicate, ...]:
    """One predicate a layer of the target; layers the jump does not name take everything."""
    given = j.predicates(row) if j.predicates else {}
    return tuple(from_json(given.get(f"layer{i}")) for i in range(len(p.canvases[j.dest].layers)))


def follow(p: Project, j: Jump, view: View, row: dict, centroid=None) -> Target:
    """The target of a jump. centroid(layer, predicate) -> (cx, cy) is called for viewports given by a centroid."""
    corner = None
    if j.viewport:
        how = j.viewport(row)
        if "constant" in how:
            corner = tuple(map(float, how["constant"]))
        elif "centroid" in how:
            ((layer, tree),) = how["centroid"].items()
            cx, cy = centroid(int(layer.removeprefix("layer")), from_json(tree))
            corner = (cx - view.width / 2, cy - view.height / 2)
    return Target(j.dest, layer_predicates(p, j, row), corner)


def jump_rows(dest: DataFrame, p: Predicate) -> DataFrame:
    return dest.where(to_column(p))


def jump_rows_batch(dest: DataFrame, clicked: DataFrame, on: list[str]) -> DataFrame:
    """Rows that any of many clicked rows leads to."""
    return dest.join(clicked.select(*on).distinct(), on, "left_semi")


def centroid(df: DataFrame, p: Predicate) -> tuple[float, float]:
    """Centre of the only row that fits a predicate."""
    if isinstance(p, Everything):
        raise ValueError("a centroid needs a predicate")
    rows = df.where(to_column(p)).select("cx", "cy").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no row fits' if not rows else 'several rows fit'} the predicate")
    return rows[0]["cx"], rows[0]["cy"]


def highlight(df: DataFrame, p: Predicate) -> DataFrame:
    """Opacity of each row: 1 where the predicate holds, 0.4 elsewhere."""
    from pyspark.sql import functions as F

    hit = to_column(p)
    return df.withColumn("highlighted", hit).withColumn("opacity", F.when(hit, 1.0).otherwise(0.4))


def slide(corner: tuple[float, float], size: tuple[float, float], direction: float) -> tuple[float, float]:
    """Corner after sliding one viewport in a direction (degrees, counter-clockwise from the right)."""
    import math

    a = math.radians(direction)
    return corner[0] + size[0] * math.cos(a), corner[1] - size[1] * math.sin(a)


def axis_range(extent: tuple[float, float], canvas: float, lo: float, hi: float) -> tuple[float, float]:
    """Data range of the visible part of an axis."""
    lo, hi = max(0.0, lo), min(canvas, hi)
    span = extent[1] - extent[0]
    return extent[0] + lo / canvas * span, extent[0] + hi / canvas * span
