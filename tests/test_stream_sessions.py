"""Stateful streams against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trajloom.operators.replay import replay_pairs
from trajloom.streaming.replay_stream import drain, read_feed
from trajloom.streaming.sessions import drain_with_fates, stream_pairs

START = datetime(2024, 1, 1)
TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


@pytest.fixture()
def turns():
    draw = random.Random(3)
    rows = []
    for conv in range(30):
        for turn in range(draw.randint(0, 9)):
            rows.append((conv, turn * 10, draw.choice(["user", "assistant", "user", "assistant", "system", None]), draw.choice([None, f"t{conv}.{turn}"]), START + timedelta(minutes=conv + turn)))
    return rows


def test_pairs_of_files_in_any_order(spark, tmp_path, turns):
    folder, out, progress = (str(tmp_path / n) for n in ("feed", "out", "progress"))
    mixed = random.Random(1).sample(turns, len(turns))
    parts = [mixed[k::4] for k in range(4)]
    states = []
    for rows in [*parts, [(None, None, None, None, START + timedelta(days=9000))]]:
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(folder)
        feed = stream_pairs(read_feed(spark, folder, spark.createDataFrame([], TURNS).schema), "ts", "1 day", 60)
        query = feed.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out)
        query.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    want = replay_pairs(spark.createDataFrame(turns, TURNS).drop("ts")).collect()
    got = spark.read.schema(feed.schema).parquet(out).collect()
    # Each once, over five restarts.
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(want) > 5
    assert states[3] > 0 and states[-1] == 0


def test_a_conversation_closes_after_its_pause(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("feed", "out", "progress"))
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(1, 0, "user", "a", at(0))], [(1, 1, "assistant", "b", at(8))], [(2, 0, "user", "c", at(60))], [(2, 1, "assistant", "d", at(61))]]
    for rows in batches:
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(folder)
        feed = stream_pairs(read_feed(spark, folder, spark.createDataFrame([], TURNS).schema), "ts", "5 minutes", 600)
        found = drain(feed, "pairs", out, progress).collect()
    assert [(r.traj_id, r.prompt, r.response) for r in found] == [("1:1", "a", "b")]  # 2 is open


def test_kept_late_and_repeated_rows_make_up_the_input(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("feed", "out", "progress"))
    schema = "id long, ts timestamp, note string"
    at = lambda m: None if m is None else START + timedelta(minutes=m)
    batches = [
        [(1, 0), (1, 0), (2, 50), (None, 3), (None, 3)],
        [(2, 50), (3, 39), (4, 40), (1, 0), (5, 55), (None, 45)],
        [(5, 55), (4, 40), (6, 46), (6, 46), (7, None), (8, 300)],
        [(8, 300), (5, 55)],
    ]
    for rows in batches:
        spark.createDataFrame([(i, at(m), "n") for i, m in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        feed = read_feed(spark, folder, spark.createDataFrame([], schema).schema)
        found = drain_with_fates(feed, ["id"], "ts", 600, out, progress)
    minute = lambda t: None if t is None else int((t - START).total_seconds() // 60)
    got = sorted(((r.batch, r.id, minute(r.ts), r.fate) for r in found.collect()), key=repr)
    want = [
        (0, 1, 0, "kept"), (0, 1, 0, "repeated"), (0, 2, 50, "kept"), (0, None, 3, "kept"), (0, None, 3, "kept"),
        (1, 2, 50, "repeated"), (1, 3, 39, "late"), (1, 4, 40, "kept"), (1, 1, 0, "late"), (1, 5, 55, "kept"), (1, None, 45, "kept"),
        (2, 5, 55, "repeated"), (2, 4, 40, "late"), (2, 6, 46, "kept"), (2, 6, 46, "repeated"), (2, 7, None, "late"), (2, 8, 300, "kept"),
        (3, 8, 300, "repeated"), (3, 5, 55, "late"),
    ]
    assert got == sorted(want, key=repr)
    # Nothing new: nothing is written again.
    assert drain_with_fates(feed, ["id"], "ts", 600, out, progress).count() == len(want)
