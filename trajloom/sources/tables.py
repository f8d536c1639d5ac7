"""Trajectories derived from general tables: rollout conversations, line items, events.

The tables carry no likelihoods, so NLL, reward and scores are simple functions of
other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.operators.replay import group_advantage, label_origin, replay_pairs
from trajloom.operators.store import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_reward(pairs: DataFrame) -> DataFrame:
    """Reward 1 for responses whose length is a multiple of three, NLL by length."""
    size = F.length("response")
    return pairs.withColumns(
        {
            "reward": F.when(size % 3 == 0, 1.0).otherwise(0.0),
            "nll_seq": size * F.lit(0.35),
        }
    )


def text_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the conversations, with untidy labels and missing values put in.

    They are written once, as a recorded trajectory table would be: the steps that
    follow read them several times.
    """
    pairs = with_reward(replay_pairs(table(spark, sf_dir, "conversations")))
    rows = group_advantage(pairs)
    label = label_origin(F.col("advantage"))
    size = F.length("response")
    untidy = (
        F.when(size % 17 == 0, F.lit(None))
        .when((label == "negative") & (size % 11 == 0), F.lit(" Negative "))
        .otherwise(label)
    )
    rows = rows.withColumn("origin_label", untidy).withColumn(
        "advantage", F.when(size % 19 != 0, F.col("advantage"))
    )
    return store(rows, "trajectories")


def scored_text_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with made-up scores, for queries that need no policy."""
    size = F.length("response")
    return text_trajectories(spark, sf_dir).withColumns(
        {
            "policy_logps": -F.col("nll_seq") + ((size % 13) - 6) * F.lit(0.5),
            "completion_len": F.greatest(F.floor(size / 4.0), F.lit(1)).cast("double"),
        }
    )


def numeric_trajectories(spark: SparkSession, sf_dir: str, null_nll: bool = False) -> DataFrame:
    """Trajectories of the line items; ``null_nll`` drops the NLL of every third line."""
    return line_trajectories(table(spark, sf_dir, "lineitem"), null_nll)


def line_trajectories(lines: DataFrame, null_nll: bool = False) -> DataFrame:
    nll = F.col("l_quantity") * 1.5
    if null_nll:
        nll = F.when(F.col("l_linenumber") != 3, nll)
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("traj_id"),
        F.col("l_orderkey").alias("group_id"),
        nll.alias("nll_seq"),
        F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("origin_label"),
        (-F.col("l_quantity") * 1.5 + (F.col("l_tax") - 0.04) * 50.0).alias("policy_logps"),
        F.col("l_quantity").cast("double").alias("completion_len"),
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_discount") - 0.05).alias("advantage"),
    )


def event_trajectories(events: DataFrame) -> DataFrame:
    """Trajectories of an event feed; the same for a static table and for a stream.

    Values are divided by 3 and 90, so that means of a few of them have no short decimal
    form whose rounding would hang on the order of a sum.
    """
    nll = F.col("value") / 3.0 + 1.0
    return events.select(
        F.col("event_id").alias("traj_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("group_id"),
        nll.alias("nll_seq"),
        F.when(F.col("event_type") == "error", "negative").otherwise("positive").alias("origin_label"),
        F.when(F.col("event_type") != "view", F.col("value") / 90.0 - 1.0).alias("advantage"),
        (-nll + (F.length("event_type") - 5) * 0.5).alias("policy_logps"),
        F.greatest(F.floor(F.col("value") / 4.0), F.lit(1)).cast("double").alias("completion_len"),
    )
