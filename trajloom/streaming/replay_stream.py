"""Structured Streaming: enrichment row by row, metrics by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.functions.metrics import METRIC_NAMES, metric_columns
from trajloom.operators.enrich import enrich, with_loss
from trajloom.operators.store import new_path
from trajloom.options import LossOptions


def read_feed(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def enriched_losses(feed: DataFrame, options: LossOptions = LossOptions()) -> DataFrame:
    """Stateless: the batch operators, unchanged."""
    return with_loss(enrich(feed, options), options)


def windowed_metrics(
    losses: DataFrame,
    ts: str = "ts",
    width: str = "1 hour",
    delay: str = "10 minutes",
    by: list[str] | None = None,
    options: LossOptions = LossOptions(),
) -> DataFrame:
    """Metrics per event-time window; state holds one partial row per open window."""
    window = F.window(ts, width)
    return (
        losses.withWatermark(ts, delay)
        .groupBy(window, *(by or []))
        .agg(F.count(F.lit(1)).alias("samples"), *metric_columns(options))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *(by or []),
            "samples",
            *METRIC_NAMES,
        )
    )


def drain(stream: DataFrame, name: str, path: str | None = None, progress: str | None = None) -> DataFrame:
    """Run a stream over all data there is now, and return the table it appended to.

    Files and progress go to the shared folder, so a restart with the same paths
    continues after the last finished batch and writes no row twice.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    progress = progress or new_path(spark, f"{name}-progress")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
