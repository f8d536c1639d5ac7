"""From rollout logs to trajectories: pairs, advantages, origin labels, mixing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.operators.lookup import BROADCAST_BYTES, HOT_ROWS, fits_broadcast, lookup_join, shuffle_partitions
from trajloom.operators.store import store

PAIR_FIELDS = "range int, edge string, group_id {group}, turn {turn}, text string, role string, before_group {group}, before_role string, before_text string"


def replay_pairs(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    ranges: int | None = None,
) -> DataFrame:
    """Each assistant turn right after a user turn, as prompt and response.

    Turns are placed by ranges of (conversation, turn), which split conversations of any
    length wherever they get too long, and each range hands its last turn to the next one.
    The texts are shuffled once; a task holds one Arrow batch. (conversation, turn) must be
    unique; turns without either are no part of a conversation. A null prompt is kept.
    """
    rows = turns.where(F.col(conversation).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conversation).alias("group_id"),
        F.col(turn).alias("turn"),
        F.col(text).alias("text"),
        F.col(role).alias("role"),
    )
    kinds = {name: rows.schema[f].dataType.simpleString() for name, f in (("group", "group_id"), ("turn", "turn"))}
    ranges = ranges or shuffle_partitions(turns.sparkSession)
    placed = rows.repartitionByRange(ranges, "group_id", "turn").sortWithinPartitions("group_id", "turn")
    placed = store(placed.mapInArrow(with_previous, PAIR_FIELDS.format(**kinds)), "turns")
    inside = placed.where("edge IS NULL")
    # Two rows per range: its first turn meets the last one of the range before.
    last = placed.where("edge = 'last'").select(
        F.col("range").alias("_range"), F.lead("range").over(Window.partitionBy(F.lit(0)).orderBy("range")).alias("range"),
        F.col("group_id").alias("_group"), F.col("role").alias("_role"), F.col("text").alias("_text"),
    ).drop("_range")
    first = placed.where("edge = 'first'").join(last, "range").select(
        "range", "edge", "group_id", "turn", "text", "role",
        F.col("_group").alias("before_group"), F.col("_role").alias("before_role"), F.col("_text").alias("before_text"),
    )
    is_pair = (F.col("role") == "assistant") & (F.col("before_role") == "user") & (F.col("group_id") == F.col("before_group"))
    return inside.union(first).where(is_pair).select(
        F.concat_ws(":", F.col("group_id").cast("string"), F.col("turn").cast("string")).alias("traj_id"),
        "group_id",
        "turn",
        F.col("before_text").alias("prompt"),
        F.col("text").alias("response"),
    )


def with_previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Assistant turns of a sorted range beside the turn before, and the range's first and last
    turn; see PAIR_FIELDS."""
    number, held = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ["group_id", "turn", "text", "role"]
        rows = pa.Table.from_batches([batch.select(names)])
        before = (rows.slice(0, 1) if held is None else held).select(["group_id", "role", "text"])
        before = pa.concat_tables([before, rows.select(["group_id", "role", "text"]).slice(0, len(rows) - 1)])
        keep = pc.equal(rows["role"], "assistant")
        if held is None:
            yield _edge(number, "first", rows.slice(0, 1))
            keep = pc.and_(keep, pa.array([False] + [True] * (len(rows) - 1)))
        held = rows.slice(len(rows) - 1, 1)
        both = pa.table([*rows.columns, *before.columns], names=[*names, "before_group", "before_role", "before_text"])
        both = both.filter(keep)
        yield from _numbered(number, None, both)
    if held is not None:
        yield _edge(number, "last", held)


def _numbered(number: int, edge: str | None, rows: pa.Table) -> list[pa.RecordBatch]:
    columns = [pa.array([number] * len(rows), pa.int32()), pa.array([edge] * len(rows), pa.string()), *rows.columns]
    return pa.table(columns, names=["range", "edge", *rows.column_names]).to_batches()


def _edge(number: int, edge: str, row: pa.Table) -> pa.RecordBatch:
    empty = [pa.nulls(1, row["group_id"].type), pa.nulls(1, pa.string()), pa.nulls(1, pa.string())]
    row = pa.table([*row.columns, *empty], names=[*row.column_names, "before_group", "before_role", "before_text"])
    return _numbered(number, edge, row)[0]


def group_advantage(
    df: DataFrame,
    group: str = "group_id",
    reward: str = "reward",
    spread: str = "traj_id",
    epsilon: float = 1e-6,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``advantage`` = (reward - group mean) / (group deviation + epsilon).

    The statistics combine on the map side and are joined back, salted for large
    groups, so no group has to fit one task. Equal rewards give exactly 0; a row
    without a group gets no advantage.
    """
    value = F.col(reward)
    stats = df.groupBy(group).agg(
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_std"),
        (F.min(value) == F.max(value)).alias("_flat"),
    )
    stats = store(stats, "groups")
    small = fits_broadcast(stats, broadcast_bytes)
    joined = lookup_join(df, stats, [group], [spread], small, hot_rows)
    advantage = F.when(F.col("_flat"), F.lit(0.0)).otherwise(
        (value - F.col("_mean")) / (F.col("_std") + epsilon)
    )
    return joined.withColumn("advantage", advantage).drop("_mean", "_std", "_flat")


def label_origin(advantage: Column) -> Column:
    """``negative`` below 0, else ``positive``; null without an advantage."""
    return F.when(advantage < 0, "negative").when(advantage >= 0, "positive")


def mix_buffers(buffers: dict[str, DataFrame], domain: str = "domain") -> DataFrame:
    """All rows of several experts' buffers, tagged with their domain."""
    tagged = [df.withColumn(domain, F.lit(name)) for name, df in buffers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
