"""Streaming ingestion: resumable extraction of arriving images, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Process each micro-batch and append its rows under ``target``/batch=N; keys already done are skipped.

    A replayed batch overwrites its own folder, so a restart neither loses nor repeats a row.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        done = finished(spark, target, key, number)
        if done is not None:
            fresh = fresh.join(done, key, "left_anti")
        process(fresh).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, target: str, key: str, before: int | None = None) -> DataFrame | None:
    """Keys of the batches written so far; None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    out = spark.read.parquet(target)
    return (out if before is None else out.filter(F.col("batch") != before)).select(key).distinct()


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and sum per tumbling window and key, with a watermark for late rows; for batch and stream alike."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")
