"""A stream of source files keeps a manifest of their newest contents.

Every micro-batch is merged into a new version of the table, written beside the old one and
published by a pointer that one atomic rename replaces: readers see the old version or the new
one, at no moment none, and a batch that runs twice after a failure changes nothing. The version
before stays for readers that still use it; older ones are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.incremental import upsert

KEY = ["repo_id", "path"]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, store: str) -> tuple[str | None, int]:
    """The folder of the current version and the batch that made it; (None, -1) before the first."""
    path, fs = _path(spark, f"{store}/current.json")
    if not fs.exists(path):
        return None, -1
    found = json.loads("".join(r[0] for r in spark.read.text(f"{store}/current.json").collect()))  # one line, by construction
    return found["folder"], found["batch"]


def read_index(spark: SparkSession, store: str) -> DataFrame | None:
    folder, _ = published(spark, store)
    return spark.read.parquet(folder) if folder else None


def publish(spark: SparkSession, store: str, table: DataFrame, batch: int) -> None:
    """Writes a version, then moves the pointer to it by a rename that replaces the old pointer."""
    before, _ = published(spark, store)
    folder = f"{store}/version-{batch}"
    table.write.mode("overwrite").parquet(folder)
    temporary, fs = _path(spark, f"{store}/current.json.new")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps({"folder": folder, "batch": batch}).encode()))
    out.close()
    final, _ = _path(spark, f"{store}/current.json")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(final), replace)
    for old in fs.listStatus(final.getParent()):
        name = old.getPath().getName()
        if name.startswith("version-") and name not in {folder.rpartition("/")[2], (before or "").rpartition("/")[2]}:
            fs.delete(old.getPath(), True)


def merge_batch(store: str):
    """The function for foreachBatch: newest row of each path of the batch over what the store holds."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder, done = published(spark, store)
        if number <= done:
            return  # this batch was published before a restart
        newest = batch.where("content is not null").groupBy(*KEY).agg(F.max(F.struct("loaded_at", F.sha2("content", 256).alias("hash"))).alias("r")).select(*KEY, "r.loaded_at", "r.hash")
        if folder is not None:
            old = spark.read.parquet(folder)
            late = newest.join(old.select(*KEY, F.col("loaded_at").alias("__have")), KEY, "left").where("__have is null or loaded_at >= __have").drop("__have")
            newest = upsert(old, late, KEY)
        publish(spark, store, newest, number)

    return merge


def index_stream(spark: SparkSession, source: str, store: str, checkpoint: str, schema, max_files: int = 100):
    """Starts the stream over a folder of parquet files; ends when all that is there has been merged."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return files.writeStream.foreachBatch(merge_batch(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and type; on a stream the watermark bounds the state and drops what is later."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
