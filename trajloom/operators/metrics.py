"""Metric tables over rows with loss columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajloom.functions.metrics import metric_columns, metric_parts, metrics_of_parts
from trajloom.options import LossOptions


def metrics(
    df: DataFrame, by: list[str] | None = None, options: LossOptions = LossOptions()
) -> DataFrame:
    """One wide row of metrics per group, or one for all rows."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("samples"), *_columns(df, options)
    )


def metrics_rollup(
    df: DataFrame, by: list[str], options: LossOptions = LossOptions()
) -> DataFrame:
    """Metrics per group and for each coarser level. ``level`` tells the levels apart.

    The rows are summed once, per finest group; only those sums are rolled up.
    """
    with_flag = "origin_is_negative" in df.columns
    finest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_samples"), *metric_parts(with_flag))
    return finest.rollup(*by).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("_samples").alias("samples"),
        *metrics_of_parts(options, with_flag),
    )


def last_metrics(
    per_batch: DataFrame, step: list[str], batch: str = "batch_id", rank: str | None = "rank"
) -> DataFrame:
    """Per optimiser step the metrics of its last forward call on the first device.

    This is the view of a log that keeps one record per call and writes one line per
    step; ``per_batch`` itself is the complete record.
    """
    if rank is not None:
        per_batch = per_batch.where(F.col(rank) == 0).drop(rank)
    values = [c for c in per_batch.columns if c not in step]
    last = F.max_by(F.struct(*values), F.col(batch)).alias("_last")
    return per_batch.groupBy(*step).agg(last).select(*step, "_last.*")


def with_prefix(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Metric columns under a prefix, such as ``eval_`` outside training."""
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """``train_samples`` and ``eval_samples``; the ``test`` split is the evaluation."""
    def count(name: str, alias: str):
        return F.count(F.when(F.col(split) == name, 1)).alias(alias)

    return df.agg(count("train", "train_samples"), count("test", "eval_samples"))


def scoreboard(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Share of correct answers per group of a table of graded answers."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("answers"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
    )


def _columns(df: DataFrame, options: LossOptions):
    return metric_columns(options, with_flag="origin_is_negative" in df.columns)
