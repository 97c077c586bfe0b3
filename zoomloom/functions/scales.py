"""Scales from data to canvas as Column expressions, and their inverses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(v: Column, domain: tuple[float, float], out: tuple[float, float]) -> Column:
    """Linear scale; reversed domains and ranges are legal, an empty domain is refused."""
    (d0, d1), (r0, r1) = domain, out
    if d0 == d1:
        raise ValueError("the domain of a linear scale is empty")
    return (v.cast("double") - F.lit(float(d0))) / F.lit(float(d1 - d0)) * F.lit(float(r1 - r0)) + F.lit(float(r0))


def invert(v: float, domain: tuple[float, float], out: tuple[float, float]) -> float:
    """Canvas position back to data, on the driver."""
    (d0, d1), (r0, r1) = domain, out
    return (v - r0) / (r1 - r0) * (d1 - d0) + d0


def invert_column(v: Column, domain: tuple[float, float], out: tuple[float, float]) -> Column:
    return linear(v, out, domain)


def time_position(year: Column, month: Column, day: Column, first: str, last: str, out: tuple[float, float]) -> Column:
    """Linear scale over days between two ISO dates; months count from 1. Impossible dates give null."""
    date = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    start = F.to_date(F.lit(first))
    span = F.datediff(F.to_date(F.lit(last)), start)
    return F.datediff(date, start).cast("double") / span * F.lit(float(out[1] - out[0])) + F.lit(float(out[0]))


def day_lane(date: Column, upper: float, lower: float, epoch: str = "2000-01-01") -> Column:
    """Even days since the epoch on the upper lane, odd days on the lower."""
    return F.when(F.pmod(F.datediff(date, F.to_date(F.lit(epoch))), F.lit(2)) == 0, F.lit(float(upper))).otherwise(F.lit(float(lower)))


def grid_slot(index: Column, columns: int, side: float, top: float = 0.0) -> tuple[Column, Column]:
    """Centre of the slot of an item laid out row by row."""
    row = F.floor(index / columns)
    return (2 * (index - row * columns) + 1) * F.lit(side), (2 * row + 1) * F.lit(side) + F.lit(top)


def rescale(v: Column, from_size: int, to_size: int) -> Column:
    """Ratio rescale between canvases; text is parsed as a whole number, bad text is null."""
    return v.try_cast("int").cast("double") / F.lit(float(from_size)) * F.lit(float(to_size))


def sqrt_scale(v: Column, domain: tuple[float, float], out: tuple[float, float]) -> Column:
    a, b = math.sqrt(domain[0]), math.sqrt(domain[1])
    return linear(F.sqrt(v), (a, b), out)


def clamped(v: Column, domain: tuple[float, float], out: tuple[float, float]) -> Column:
    lo, hi = min(domain), max(domain)
    return linear(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)), domain, out)


def band(index: Column, count: int, out: tuple[float, float], padding: float = 0.1) -> tuple[Column, float]:
    """(start, width) of the index-th of `count` bands with equal inner and outer padding."""
    step = (out[1] - out[0]) / max(1.0, count + padding)
    return index * F.lit(step) + F.lit(out[0] + padding * step), step * (1 - padding)


def threshold_breaks(lo: float, hi: float, colors: int, step: float | None = None) -> list[float]:
    """lo, lo + step, ... up to hi, as many as there are colours at most."""
    step = step if step is not None else (hi - lo) / colors
    if step <= 0:
        raise ValueError("the step of a threshold scale is positive")
    out = []
    while len(out) < colors and lo + step * len(out) <= hi:
        out.append(lo + step * len(out))
    return out


def threshold_bin(v: Column, breaks: list[float]) -> Column:
    """Number of breaks at or below v: the first bin whose break is greater; null stays null."""
    total = F.lit(0)
    for b in breaks:
        total = total + F.when(v >= F.lit(float(b)), 1).otherwise(0)
    return F.when(v.isNotNull(), total)


def short_number(v: float) -> str:
    """SI-prefixed form of a number with four significant digits (presentation only)."""
    if v == 0:
        return "0"
    prefixes = {-3: "n", -2: "µ", -1: "m", 0: "", 1: "k", 2: "M", 3: "G", 4: "T", 5: "P"}
    e = max(-3, min(5, math.floor(math.log10(abs(v)) / 3)))
    return f"{v / 1000**e:.4g}{prefixes[e]}"


def parse_number(text: Column) -> Column:
    """The number a text starts with, thousands commas allowed; anything else is 0."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.regexp_replace(found, ",", "").try_cast("double"), F.lit(0.0))


def swap_score(text: Column) -> Column:
    """'a - b' becomes 'b - a'; 'None' becomes empty."""
    parts = F.split(text, " - ")
    return F.when(text == "None", "").when(F.size(parts) == 2, F.concat(parts[1], F.lit(" - "), parts[0])).otherwise(text)


def truncate_label(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
