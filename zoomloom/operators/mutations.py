"""Updates of written layers: by key, with the columns a base table has, and inverse transforms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def update_rows(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of `changes` replaced where all keys match; null changes set null, other rows stay as they are.

    Changes with the same key: the greatest by its values wins, so that no row doubles. Spark broadcasts the changes where they are small.
    """
    fields = [c for c in changes.columns if c not in keys and c in df.columns]
    one = changes.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__new"))
    joined = df.join(one, keys, "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def changed_columns(attributes: list[str], base: DataFrame) -> list[str]:
    """Attributes that the base table has."""
    return [a for a in attributes if a in base.columns]


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replace a Parquet table by change(table). Written beside it, then both are renamed; if that fails the old table is put back."""
    fresh, aside = (f"{path}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    change(spark.read.parquet(path)).write.parquet(fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, source, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, aside))
    fs = target.getFileSystem(conf)
    if not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(source, target):
        fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def reverse_time(x: Column, first: str, days: int, out: tuple[float, float]) -> dict[str, Column]:
    """Year, month and day of a position on a time axis."""
    date = F.date_add(F.to_date(F.lit(first)), F.round((x - F.lit(float(out[0]))) / F.lit(float(out[1] - out[0])) * days).cast("int"))
    return {"year": F.year(date), "month": F.month(date), "day": F.day(date)}


def insert_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of another query added; columns it lacks are null, columns df lacks are left out."""
    return df.unionByName(more.select(*[c for c in more.columns if c in df.columns]), allowMissingColumns=True)


def change_columns(df: DataFrame, add: dict[str, Column] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Columns added, then others dropped."""
    return df.withColumns(add or {}).drop(*(drop or []))


def remove_rows(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")
