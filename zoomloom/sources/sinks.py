"""Written state: layers, project specifications, the fetch log, rendering parameters, pyramid information."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.sources import manifest

LOG = "project_name string, canvas_id string, query_type string, fetch_time_ms double, rows_fetched long, logged_at double"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace what is there: a build can run again."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_document(spark: SparkSession, path: str, key: str, content: dict) -> None:
    """Put one JSON document under a key, replacing an earlier one; no job runs."""
    manifest.write_text(spark, f"{path}/{_name(key)}.json", json.dumps(content, sort_keys=True, default=str))


def load_document(spark: SparkSession, path: str, key: str) -> dict | None:
    """The document under a key."""
    text = manifest.read_text(spark, f"{path}/{_name(key)}.json")
    return json.loads(text) if text else None


def _name(key: str) -> str:
    """A file name for any key."""
    return re.sub(r"[^\w-]", lambda m: f"%{ord(m.group()):x}.", key)


def log_fetch(spark: SparkSession, path: str, entries: list[tuple]) -> None:
    """Append fetches (project, canvas, kind, ms, rows); a session appends in batches, not one file a fetch."""
    spark.createDataFrame([(*e, time.time()) for e in entries], LOG).coalesce(1).write.mode("append").parquet(path)


def fetch_statistics(log: DataFrame) -> DataFrame:
    """Fetches, mean and median time and rows of each kind of query."""
    return log.groupBy("query_type").agg(F.count(F.lit(1)).alias("fetches"), F.avg("fetch_time_ms").alias("mean_ms"), F.percentile_approx("fetch_time_ms", 0.5, 10_000).alias("median_ms"), F.sum("rows_fetched").cast("long").alias("rows"))
