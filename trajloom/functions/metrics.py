"""Batch metrics as aggregate Columns over rows that carry the loss columns.

All of them are means, so Spark combines them on the map side and a group of any
size costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajloom.functions.offpolicy import flag_is_set
from trajloom.options import LossOptions

MEANS = {
    "rewards_chosen": "reward",
    "logps_chosen": "policy_logps",
    "ratio_mean": "ratio",
    "w_mean": "w",
    "weight_mean": "weight",
    "loss": "loss",
    "completion_len_mean": "completion_len",
    "old_logp_mean": "old_logps",
    "data_advantage_mean": "advantage_used",
}
METRIC_NAMES = [*MEANS, "frac_capped", "frac_origin_negative", "length_normalize"]


def metric_values(with_flag: bool = True) -> dict[str, Column]:
    """What each metric is the mean of."""
    values = {name: F.col(source) for name, source in MEANS.items()}
    values["frac_capped"] = F.col("capped").cast("double")
    if with_flag:
        values["frac_origin_negative"] = flag_is_set(F.col("origin_is_negative")).cast("double")
    return values


def metric_columns(options: LossOptions = LossOptions(), with_flag: bool = True) -> list[Column]:
    columns = [F.avg(value).alias(name) for name, value in metric_values(with_flag).items()]
    # A constant, but written as an aggregate so that it sits in any groupBy.
    return [*columns, F.max(F.lit(float(options.length_normalize))).alias("length_normalize")]


def metric_parts(with_flag: bool = True) -> list[Column]:
    """Sum and count of each metric, to be combined by :func:`metrics_of_parts`."""
    return [
        part
        for name, value in metric_values(with_flag).items()
        for part in (F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n"))
    ]


def metrics_of_parts(options: LossOptions = LossOptions(), with_flag: bool = True) -> list[Column]:
    means = [
        (F.sum(f"{name}_sum") / F.nullif(F.sum(f"{name}_n"), F.lit(0))).alias(name)
        for name in metric_values(with_flag)
    ]
    return [*means, F.max(F.lit(float(options.length_normalize))).alias("length_normalize")]
