"""Seeded order, epochs, batches, optimiser steps and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajloom.functions.tokens import pad_right
from trajloom.operators.indexing import hash_positions, order_key
from trajloom.operators.lookup import shuffle_partitions
from trajloom.options import BatchOptions, TokenOptions

# Rows that are padded together: what one device takes in one forward call.
BATCH_KEYS = ["epoch", "batch_id", "rank"]
# Rows of a shard, about: a folder of the training set.
SHARD_ROWS = 1_000_000


def assign_batches(
    df: DataFrame, id_col: str = "traj_id", options: BatchOptions = BatchOptions()
) -> DataFrame:
    """One narrow row per trajectory and epoch with its place in the training run.

    Columns: the id, ``epoch``, ``position`` (in the epoch's order), ``batch_id``
    (forward call), ``rank`` (device), ``step_id`` (in the epoch) and ``global_step``.
    Only ids are shuffled here; join the result to the wide rows.
    """
    count = options.epochs
    if options.max_steps is not None:
        # The step count wins over the epochs: rows come again until it is reached.
        per_epoch = max(1, -(-df.count() // (options.rows_per_batch * options.accumulation)))
        count = max(1, -(-options.max_steps // per_epoch))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = df.select(id_col, epochs.alias("epoch"))
    rows = rows.withColumn("_key", order_key(options.seed, F.col("epoch"), F.col(id_col)))
    placed = hash_positions(rows, "_key", ["epoch"])
    size, position = options.rows_per_batch, F.col("position")
    step_rows = size * options.accumulation
    batch = F.floor(position / size)
    step = F.floor(batch / options.accumulation)
    steps_per_epoch = F.ceil(F.col("total") / step_rows)
    placed = placed.select(
        id_col,
        "epoch",
        "position",
        batch.alias("batch_id"),
        F.floor((position % size) / options.per_device).alias("rank"),
        step.alias("step_id"),
        (F.col("epoch") * steps_per_epoch + step).alias("global_step"),
    )
    if options.max_steps is not None:
        placed = placed.where(F.col("global_step") < options.max_steps)
    return placed


def pad_batches(
    df: DataFrame, options: TokenOptions = TokenOptions(), keys: list[str] = BATCH_KEYS
) -> DataFrame:
    """Pad the token lists of each batch to its longest, and add ``batch_max_len``."""
    batch = Window.partitionBy(*keys)
    longest = F.greatest(
        F.max(F.size("input_ids")).over(batch), F.max(F.size("labels")).over(batch)
    )
    sized = df.withColumn("batch_max_len", longest)
    missing = F.col("batch_max_len") - F.size("input_ids")
    return sized.withColumns(
        {
            "input_ids": pad_right(F.col("input_ids"), options.pad_id, missing),
            "attention_mask": pad_right(F.col("attention_mask"), 0, missing),
            "labels": pad_right(F.col("labels"), options.label_pad_token_id, missing),
        }
    )


def training_set(
    df: DataFrame,
    assignment: DataFrame,
    id_col: str = "traj_id",
    options: TokenOptions = TokenOptions(),
    batches_per_shard: int | None = None,
) -> DataFrame:
    """Padded batches in training order, ready to write by epoch and shard.

    A shard is a run of consecutive batches, by default so many that it has SHARD_ROWS rows
    and there are at most as many shards as shuffle partitions. Rows are placed by shard
    once; padding and sorting both use that placement. Ids must be unique.
    """
    if batches_per_shard is None:
        batches_per_shard = shard_batches(assignment)
    rows = assignment.withColumn("shard", F.floor(F.col("batch_id") / batches_per_shard))
    placed = df.join(rows, id_col).repartition("epoch", "shard")
    padded = pad_batches(placed, options, ["epoch", "shard", "batch_id", "rank"])
    return padded.sortWithinPartitions("epoch", "shard", "batch_id", "rank", "position")


def shard_batches(assignment: DataFrame) -> int:
    """Batches per shard, from the numbers of rows and batches of an epoch."""
    rows, batches = assignment.where("epoch = 0").agg(F.count(F.lit(1)), F.max("batch_id") + 1).first()
    if not rows:
        return 1
    shards = min(-(-rows // SHARD_ROWS), shuffle_partitions(assignment.sparkSession))
    return max(1, -(-batches // shards))
