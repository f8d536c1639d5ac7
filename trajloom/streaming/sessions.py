"""Stateful streams: prompt/response pairs of growing conversations, late and repeated rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajloom.operators.store import new_path, store

HELD = "turns array<long>, roles array<string>, texts array<string>, latest long"
PAIRS = ["traj_id", "group_id", "turn", "prompt", "response"]


def stream_pairs(
    turns: DataFrame,
    ts: str,
    delay: str,
    pause_seconds: float,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The pairs of :func:`trajloom.operators.replay.replay_pairs`, from a stream of turns.

    Turns may come in any order within ``delay``. A conversation is done when the watermark is more
    than ``pause_seconds`` past its latest turn; its pairs are then written and its state goes. Only
    open conversations are held, each by one task. Rows without conversation or turn move
    the watermark and nothing else. The texts of a conversation must fit a task.
    """
    group = turns.schema[conversation].dataType.simpleString()
    pause = max(round(pause_seconds * 1000), 1)

    def pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], 0)
        if state.hasTimedOut:
            state.remove()
            found, before = [], None
            for row in sorted(zip(*held[:3]), key=lambda r: r[0]):
                if before is not None and row[1] == "assistant" and before[1] == "user":
                    found.append((f"{key[0]}:{row[0]}", key[0], row[0], before[2], row[2]))
                before = row
            yield pd.DataFrame(found, columns=PAIRS)
            return
        numbers, roles, texts = (list(x) for x in held[:3])
        latest = int(held[3])
        for frame in frames:
            frame = frame[frame["turn"].notna()]
            if pd.isna(key[0]) or not len(frame):
                continue
            numbers += [int(n) for n in frame["turn"]]
            roles += [None if pd.isna(r) else r for r in frame["role"]]
            texts += [None if pd.isna(t) else t for t in frame["text"]]
            latest = max(latest, int(frame["millis"].max()))
        if numbers:
            state.update((numbers, roles, texts, latest))
            state.setTimeoutTimestamp(max(latest + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=PAIRS)

    rows = turns.withWatermark(ts, delay).select(
        F.col(conversation).alias("group_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.unix_millis(F.col(ts)).alias("millis"), F.col(ts).alias("_at"),
    )
    schema = f"traj_id string, group_id {group}, turn long, prompt string, response string"
    return rows.groupBy("group_id").applyInPandasWithState(pairs, schema, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def drain_with_fates(feed: DataFrame, ids: list[str], ts: str, delay_seconds: float, path: str, progress: str) -> DataFrame:
    """Run a stream over all data there is now; its rows with ``batch`` and ``fate``.

    ``late`` rows are older than the latest time of all earlier batches less the delay;
    ``repeated`` ones are not late and have the ids of a row kept before that is not too old
    itself, or of another row of the batch; all else is ``kept``. Kept, late and repeated rows make up
    the input. A batch that runs again after a failure replaces what it wrote. Rows with a
    null time are late as soon as there is a bound, rows with a null id are never repeated.
    """
    spark = feed.sparkSession
    columns = feed.columns
    written = T.StructType([*feed.schema.fields, T.StructField("fate", T.StringType()), T.StructField("batch", T.LongType())])

    def run(batch: DataFrame, number: int) -> None:
        own = store(batch.withColumn("_row", F.monotonically_increasing_id()), "stream-batch")
        before = spark.read.schema("latest timestamp, batch long").parquet(f"{path}/marks") if number else None
        # One row per batch.
        latest = before.where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        bound = F.lit(latest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.lit(False) if latest is None else F.coalesce(F.col(ts) < bound, F.lit(True))
        named = own.withColumn("_late", late)
        whole = [F.col(c).isNotNull() for c in ids]
        has_id = F.forall(F.array(*whole), lambda x: x)
        # The first row of each id, combined before the shuffle; then rows meet by their own number.
        firsts = named.where(~F.col("_late") & has_id).groupBy(*ids).agg(F.min(F.struct(ts, "_row")).alias("_first"))
        if latest is not None:
            known = spark.read.schema(written).parquet(f"{path}/rows")
            known = known.where((F.col("batch") < number) & (F.col("fate") == "kept") & (F.col(ts) >= bound)).select(*ids)
            firsts = firsts.join(known, ids, "left_anti")
        chosen = firsts.select(F.col("_first._row").alias("_row"), F.lit(True).alias("_is_first"))
        fate = F.when(F.col("_late"), "late").when(F.col("_is_first") | ~has_id, "kept").otherwise("repeated")
        result = named.join(chosen, "_row", "left").select(*columns, fate.alias("fate"))
        result.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        own.agg(F.max(ts).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    query = feed.writeStream.foreachBatch(run).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(written).parquet(f"{path}/rows")


def new_paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """Folders of a feed, its result and its progress."""
    return new_path(spark, f"{name}-feed"), new_path(spark, name), new_path(spark, f"{name}-progress")
