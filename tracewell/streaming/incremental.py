"""Streams and incremental work: file streams in micro-batches, what a change touches, deltas, and session dedupe."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.runtime import own_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, per_tick: int = 64) -> DataFrame:
    """New Parquet files of a folder (or the one file), at most so many per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_tick)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def drained(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", progress: str | None = None) -> None:
    """Run a stream over all that is there now. progress: a lasting folder all executors share; named again, a run goes on from the last
    tick that was handled. Without one the progress is that of this run alone and goes with the application."""
    progress = progress or f"{own_dir(stream.sparkSession)}/progress-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result as a table: ticks append to it, or replace it in complete mode. A repeated tick overwrites its own part, so
    each counts once."""
    spark = stream.sparkSession
    out = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, tick: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/all" if mode == "complete" else f"{out}/tick={tick}")

    drained(stream, write, mode)
    return spark.read.schema(schema).parquet(f"{out}/all" if mode == "complete" else out)


def event_windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and kind; the same on a stream and on a table."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late) if events.isStreaming else events.where("ts is not null")
    return rows.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def affected(changed: DataFrame, dependencies: DataFrame, steps: int = 1) -> DataFrame:
    """(path): the changed paths and what depends on them. dependencies: (source, target): source must be redone when target changes."""
    out = changed.select("path").distinct()
    for _ in range(steps):
        hit = dependencies.join(out.withColumnRenamed("path", "target"), "target", "left_semi").select(F.col("source").alias("path"))
        out = out.union(hit).distinct()
    return out


def delta(old: DataFrame, new_rows: DataFrame, touched: DataFrame, owner: str = "path") -> DataFrame:
    """The table after redoing the touched owners only: their old rows leave, their new ones enter."""
    return old.join(touched.select(F.col("path").alias(owner)), owner, "left_anti").unionByName(new_rows.join(touched.select(F.col("path").alias(owner)), owner, "left_semi"))


def unsent(items: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Items not yet sent in their session; on a stream, use first_seen."""
    return items.dropDuplicates(keys).join(sent.select(*keys).distinct(), keys, "left_anti")


def first_seen(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row that changes when any row does, whatever their order: derived tables are redone when it differs from the stored one."""
    # A null leaves xxhash64 as it is, so which columns are null is hashed too.
    row = F.xxhash64(*cols, *[F.isnull(c) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("mix"))
