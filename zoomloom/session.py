"""Session helpers: a local session for tests, the shared scratch folder, table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("zoomloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ZOOMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="zoomloom-"), "zoomloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a session on one machine (tests) may leave it unset and gets a temporary one; on a cluster each executor would write to its own disk
    and rows would be missing, so that is refused.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="zoomloom-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives the loss of executors.

    The schema goes along, so reading starts no job. Tables that nothing reads any more are dropped with `discard`; whoever runs many
    queries in one session clears the folder as a checkpoint folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no other DataFrame reads any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster, as far as the session knows them."""
    return max(2, spark.sparkContext.defaultParallelism)


def widen(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are task slots: for costly row-wise work on a few large files.

    Tables that have enough partitions, as all large ones do, are not shuffled; the rows are the same either way.
    """
    slots = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def check_names(*names: str) -> None:
    """Refuse a result that would have two columns of one name."""
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"two columns of one name in {names}")
