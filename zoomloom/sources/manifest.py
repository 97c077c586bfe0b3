"""Written tables with a manifest: a small document names the files that count, so a change adds files and then switches the manifest.

Readers see the old or the new table, never a mixture, and a change rewrites the files it touches only. Documents go through the Hadoop file
system, so the folder may lie wherever the executors' shared folder does.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a text at a path, replacing what is there in one step: written beside it, then renamed over it."""
    jvm, target, fs = _fs(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), how)


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm, target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _data_files(spark: SparkSession, folder: str) -> list[str]:
    _, target, fs = _fs(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(target) if s.getPath().getName().endswith(".parquet"))


def save_table(df: DataFrame, folder: str, **told) -> None:
    """Write df as the table in a folder; `told` is kept with it. Files of the table before stay for its readers until the next change."""
    spark = df.sparkSession
    old = manifest(spark, folder)
    fresh = f"{folder}/data-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(fresh)
    write_text(spark, f"{folder}/manifest.json", json.dumps({"schema": df.schema.jsonValue(), "files": _data_files(spark, fresh), "before": old["files"] if old else [], **told}))
    _remove(spark, old["before"] if old else [])


def manifest(spark: SparkSession, folder: str) -> dict | None:
    text = read_text(spark, f"{folder}/manifest.json")
    return json.loads(text) if text else None


def read_table(spark: SparkSession, folder: str, known: dict | None = None) -> DataFrame:
    """The table in a folder; with a manifest already at hand, nothing is looked up."""
    m = known or manifest(spark, folder)
    if m is None:
        raise FileNotFoundError(f"no table in {folder}")
    schema = T.StructType.fromJson(m["schema"])
    return spark.read.schema(schema).parquet(*m["files"]) if m["files"] else spark.createDataFrame([], schema)


def change_table(spark: SparkSession, folder: str, touched, change) -> int:
    """Replace the rows of the files that hold rows of touched(df) by change(rows of these files); the number of files rewritten.

    Rows keep their order within a file and its share of the canvas, so a layer stays clustered.
    """
    m = manifest(spark, folder)
    df = read_table(spark, folder, m)
    hit = {r[0] for r in touched(df.withColumn("__file", F.input_file_name())).select("__file").distinct().collect()}  # files, not rows
    bare = lambda p: p.split(":", 1)[-1].lstrip("/")
    names = {bare(p) for p in hit}
    old = [f for f in m["files"] if bare(f) in names]
    if not old:
        return 0
    fresh = f"{folder}/data-{uuid.uuid4().hex}"
    some = spark.read.schema(df.schema).parquet(*old).withColumns({"__file": F.input_file_name(), "__row": F.monotonically_increasing_id()})
    change(some).repartition(len(old), "__file").sortWithinPartitions("__file", "__row").drop("__file", "__row").write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(fresh)
    gone = m["before"]
    m |= {"files": [f for f in m["files"] if f not in old] + _data_files(spark, fresh), "before": old}
    write_text(spark, f"{folder}/manifest.json", json.dumps(m))
    _remove(spark, gone)
    return len(old)


def _remove(spark: SparkSession, files: list[str]) -> None:
    for f in files:
        _, target, fs = _fs(spark, f)
        fs.delete(target, False)
