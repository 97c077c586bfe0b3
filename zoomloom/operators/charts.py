"""Grouped charts: aggregates with top N, sample layers, pie angles, stacked bars, layouts of small results."""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoomloom.operators.tables import number_rows

MEASURE = re.compile(r"^(AVG|SUM|COUNT|MAX|MIN)\((.+)\)$", re.I)
LIMITS = {"pie": 20, "treemap": 80, "circlePack": 150, "bar": 25, "wordCloud": 100}
SAMPLE_ROWS = 75


def measure_column(measure: str) -> Column:
    """AVG|SUM|COUNT|MAX|MIN of a column, or COUNT(*); anything else is refused."""
    m = MEASURE.match(measure.strip())
    if not m:
        raise ValueError(f"bad measure {measure!r}")
    name, arg = m.group(1).lower(), m.group(2).strip()
    if arg == "*":
        if name != "count":
            raise ValueError("only COUNT takes *")
        return F.count(F.lit(1))
    if not re.fullmatch(r"\w+", arg):
        raise ValueError("a measure takes one column")
    return getattr(F, name)(arg)


def chart(df: DataFrame, kind: str, dimensions: list[str], measure: str, stack: list[str] | None = None, where: Column | None = None, limit: int | None = None, value: str = "agg_value", palette: list[str] | None = None) -> DataFrame:
    """Grouped aggregate of a chart: groups without a value are left out, the largest come first, ties by dimension. A pie has no more slices than
    its palette has colours.

    The predicate applies before grouping. Stack dimensions (bars only) join the grouping.
    """
    if kind not in LIMITS:
        raise ValueError(f"unknown chart {kind!r}")
    if stack and kind != "bar":
        raise ValueError("only bars are stacked")
    rows = df if where is None else df.where(where)
    keys = [*dimensions, *(stack or [])]
    out = rows.groupBy(*keys).agg(measure_column(measure).alias(value)).where(F.col(value).isNotNull())
    most = limit or LIMITS[kind]
    return out.orderBy(F.desc(value), *keys).limit(min(most, len(palette)) if palette and kind == "pie" else most)


def sample_layer(df: DataFrame, columns: list[str], order: list[str], where: Column | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in a fixed order, shown beside a chart."""
    return (df if where is None else df.where(where)).select(*dict.fromkeys([*columns, *order])).orderBy(*order).limit(rows)


def pie_angles(df: DataFrame, value: str, keys: list[str], by_value: bool = True) -> DataFrame:
    """Share of the total and start and end angle of each slice; largest first, or in key order. A chart has few rows."""
    order = W.orderBy(*([F.desc(value)] if by_value else []), *keys)
    total = F.sum(value).over(W.partitionBy())
    upto = F.sum(value).over(order.rowsBetween(W.unboundedPreceding, 0))
    turn = F.lit(2 * math.pi)
    return df.withColumns({"share": F.col(value) / total, "start_angle": (upto - F.col(value)) / total * turn, "end_angle": upto / total * turn})


def stacked_bars(df: DataFrame, value: str, major: list[str], stack: str) -> DataFrame:
    """Running and total height of each bar; parts in order of the stack dimension."""
    own = W.partitionBy(*major)
    return df.withColumns({"bar_height": F.sum(value).over(own.orderBy(stack).rowsBetween(W.unboundedPreceding, 0)), "bar_total": F.sum(value).over(own)})


def cloud_sizes(df: DataFrame, value: str, smallest: float = 10.0, largest: float = 60.0) -> DataFrame:
    """Font sizes of a word cloud, linear between the least and greatest value."""
    lo, hi = F.min(value).over(W.partitionBy()), F.max(value).over(W.partitionBy())
    part = F.when(hi == lo, F.lit(1.0)).otherwise((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0)))
    return df.withColumn("font_size", F.lit(smallest) + part * F.lit(largest - smallest))


def domain_keys(domains: list[list[str]]) -> list[tuple]:
    """All combinations of declared dimension values."""
    return list(itertools.product(*domains))


def fill_domain(df: DataFrame, domains: dict[str, list], measures: dict[str, str]) -> DataFrame:
    """Every declared combination once; missing count, sum, avg and sqrsum are 0, missing min the least positive double, missing max the greatest."""
    missing = {"min": 5e-324, "max": 1.7976931348623157e308}
    names = list(domains)
    full = df.sparkSession.createDataFrame(domain_keys([domains[n] for n in names]), [*names])
    joined = F.broadcast(full).join(df, names, "left") if len(full.columns) else df  # declared in the spec, so small
    return joined.select(*names, *[F.coalesce(F.col(c), F.lit(missing.get(f, 0)).cast(df.schema[c].dataType)).alias(c) for c, f in measures.items()])


def treemap(values: list[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Squarified rectangles (x, y, w, h) for values in descending order, on the driver (a chart has 80 at most)."""
    total = sum(values)
    if total <= 0:
        return [(0.0, 0.0, 0.0, 0.0)] * len(values)
    areas = [v / total * width * height for v in values]
    out, x, y, w, h = [], 0.0, 0.0, width, height
    i = 0
    while i < len(areas):
        side = min(w, h)
        row, worst = [], math.inf
        for a in areas[i:]:
            s = sum(row) + a
            now = max(max(side * side * r / (s * s), s * s / (side * side * r)) if r else math.inf for r in [*row, a])
            if row and now > worst:
                break
            row.append(a)
            worst = now
        s = sum(row)
        thick = s / side if side else 0.0
        at = 0.0
        for a in row:
            length = a / thick if thick else 0.0
            out.append((x, y + at, thick, length) if w >= h else (x + at, y, length, thick))
            at += length
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        i += len(row)
    return out


def radar_points(df: DataFrame, key: list[str], measures: dict[str, tuple[float, float]], radius: float) -> DataFrame:
    """One point a measure: angle pi/2 + 2 pi i/n, distance linear in the measure's extent."""
    n = len(measures)
    cells = [F.struct(F.lit(m).alias("measure"), F.lit(math.pi / 2 + 2 * math.pi * i / n).alias("angle"), ((F.col(m) - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(float(radius))).alias("r")) for i, (m, (lo, hi)) in enumerate(measures.items())]
    out = df.select(*key, F.explode(F.array(*cells)).alias("p")).select(*key, "p.*")
    return out.withColumns({"px": F.col("r") * F.cos("angle"), "py": -F.col("r") * F.sin("angle")})


def pack_circles(radii: list[float]) -> list[tuple[float, float]]:
    """Centres of circles that touch without overlapping, placed one after another next to the origin, on the driver (a chart has 150 at most)."""
    out: list[tuple[float, float]] = []
    for i, r in enumerate(radii):
        if i == 0:
            out.append((0.0, 0.0))
            continue
        if i == 1:
            out.append((radii[0] + r, 0.0))
            continue
        best = None
        for a in range(i):
            for b in range(a):
                (xa, ya), (xb, yb) = out[a], out[b]
                da, db, d = radii[a] + r, radii[b] + r, math.hypot(xb - xa, yb - ya)
                if d == 0 or d > da + db:
                    continue
                along = (da * da - db * db + d * d) / (2 * d)
                aside = math.sqrt(max(0.0, da * da - along * along))
                for sign in (1, -1):
                    x = xa + along * (xb - xa) / d - sign * aside * (yb - ya) / d
                    y = ya + along * (yb - ya) / d + sign * aside * (xb - xa) / d
                    if all(math.hypot(x - u, y - v) >= r + q - 1e-9 * (r + q) for (u, v), q in zip(out, radii)):
                        far = math.hypot(x, y)
                        if best is None or far < best[0] - 1e-12:
                            best = (far, x, y)
        out.append((best[1], best[2]))
    return out


def ordinal_colors(df: DataFrame, column: str, palette: list[str]) -> DataFrame:
    """A colour for each value, in the order of the values, around the palette. The distinct values are numbered in parallel."""
    values = number_rows(df.select(F.col(column).alias("__v")).distinct(), ["__v"], "__v", name="__i")
    color = F.element_at(F.array(*map(F.lit, palette)), (F.pmod(F.col("__i") - 1, F.lit(len(palette))) + 1).cast("int"))
    picked = values.select("__v", color.alias("color"))
    return df.join(picked, df[column].eqNullSafe(F.col("__v")), "left").drop("__v")
