"""Synthetic points: uniform, and with four fifths of the rows in one corner. Seeded; made in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_points(spark: SparkSession, n: int, width: int, height: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.floor(F.rand(seed) * width).cast("int").alias("w"), F.floor(F.rand(seed + 1) * height).cast("int").alias("h"))


def skewed_points(spark: SparkSession, n: int, width: int = 100_000, height: int = 100_000, share: float = 0.8, corner: tuple[int, int] = (40_000, 50_000), seed: int = 1) -> DataFrame:
    """`share` of the rows in [0, corner), the rest anywhere."""
    crowded = F.rand(seed) < share
    w = F.when(crowded, F.rand(seed + 1) * corner[0]).otherwise(F.rand(seed + 1) * width)
    h = F.when(crowded, F.rand(seed + 2) * corner[1]).otherwise(F.rand(seed + 2) * height)
    return spark.range(n).select("id", F.floor(w).cast("int").alias("w"), F.floor(h).cast("int").alias("h"))


def series(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).withColumnRenamed("id", "n")
