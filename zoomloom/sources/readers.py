"""Sources: SQL over registered tables, Parquet, CSV, JDBC; schema without a job."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Any SELECT over registered tables; joins, subqueries and aggregates are Spark's."""
    return spark.sql(sql)


def register(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def load_csv(spark: SparkSession, path: str, name: str | None = None, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A headed CSV file as a view, named after the file unless a name is given. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    df.createOrReplaceTempView(name or os.path.splitext(os.path.basename(path.rstrip("/")))[0].replace("-", "_"))
    return df


def load_jdbc(spark: SparkSession, url: str, table: str, fetch: int = 1000, **options: str) -> DataFrame:
    """A table or '(query) alias' of a database; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options).load()


class Connections:
    """Databases by name: url and options are given once, tables and queries are read by name, each reader made once."""

    def __init__(self, spark: SparkSession):
        self.spark, self._known, self._made = spark, {}, {}

    def register(self, name: str, url: str, **options: str) -> None:
        self._known[name] = (url, options)
        self._made = {k: v for k, v in self._made.items() if k[0] != name}

    def read(self, name: str, table: str, fetch: int = 1000) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"no database {name!r}")
        key = (name, table, fetch)
        if key not in self._made:
            url, options = self._known[name]
            self._made[key] = load_jdbc(self.spark, url, table, fetch, **options)
        return self._made[key]


def column_names(spark: SparkSession, sql: str, declared: list[str] | None = None) -> list[str]:
    """Declared names, else those of the query; no job runs."""
    return list(declared) if declared else spark.sql(sql).columns


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def rows_as_text(df: DataFrame, batch: int | None = None):
    """Rows as lists of text for a client ('' for null). With a batch, lists of so many rows, read partition by partition, so that a result of any
    size passes through the driver; without, the rows of a small result."""
    text = lambda r: ["" if v is None else str(v) for v in r]
    if not batch:
        yield from map(text, df.collect())
        return
    rows = map(text, df.toLocalIterator(prefetchPartitions=True))
    while part := list(itertools.islice(rows, batch)):
        yield part
