"""Ranked tables: numbered rows, cell positions, canvas size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoomloom.session import materialize


def parse_order(order: str | None) -> list:
    """'a, b desc' to sort columns; an order is required, so that numbers are stable."""
    if not order:
        raise ValueError("a numbered table needs an order")
    out = []
    for part in order.split(","):
        words = part.split()
        if len(words) not in (1, 2) or (len(words) == 2 and words[1].lower() not in ("asc", "desc")):
            raise ValueError(f"bad order {part!r}")
        out.append(F.desc(words[0]) if len(words) == 2 and words[1].lower() == "desc" else F.asc(words[0]))
    return out


def number_rows(df: DataFrame, fields: list[str], order: str, group_by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Fields, then group columns not among them, then row numbers (long) from 1: over all rows, or within each group.

    The numbers are made in parallel, whatever a group's size: rows are range-partitioned by group and order, and each partition adds the rows of its
    groups that lie in partitions before it. Only groups that cross a border have any, at most one a border. The order should be total.
    """
    groups = list(group_by or [])
    cols = [*fields, *[g for g in groups if g not in fields]]
    keys = parse_order(order)
    ranged = materialize(df.repartitionByRange(*groups, *keys).withColumn("__p", F.spark_partition_id()))  # the partition of a row must not change between uses
    one = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)] or [F.lit(0).alias("__g0")]
    names = [f"__g{i}" for i in range(len(one))]
    marked = ranged.withColumns({n: c for n, c in zip(names, one)})
    sizes = marked.groupBy(*names, "__p").agg(F.count(F.lit(1)).alias("__n"))
    own = W.partitionBy(*names)
    crossing = sizes.withColumn("__parts", F.count(F.lit(1)).over(own)).where("__parts > 1")
    before = crossing.withColumn("__before", F.coalesce(F.sum("__n").over(own.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # F.broadcast: at most two rows a partition
    ahead = F.broadcast(before.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("__p").alias("__pb"), "__before"))
    same = [F.col("__p") == F.col("__pb"), *[F.col(n).eqNullSafe(F.col(f"{n}b")) for n in names]]
    place = F.row_number().over(W.partitionBy("__p", *names).orderBy(*keys)).cast("long")
    return marked.withColumn("__rn", place).join(ahead, same, "left").select(*cols, (F.col("__rn") + F.coalesce("__before", F.lit(0))).alias(name))


def cell_position(df: DataFrame, cell_height: float, head: float, y0: float, name: str = "rn") -> DataFrame:
    """Centre of a row's cells below the heads."""
    return df.withColumn("cell_y", F.lit(float(head + y0)) + F.lit(float(cell_height)) * (F.col(name) - F.lit(0.5)))


def canvas_height(df: DataFrame, cell_height: int, heads_height: int, where=None) -> DataFrame:
    """Height of the canvas that holds all rows that fit the predicate."""
    return (df if where is None else df.where(where)).agg((F.count(F.lit(1)) * cell_height + heads_height).alias("height"))
