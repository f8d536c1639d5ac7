"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trajloom.operators.enrich import enrich, with_loss
from trajloom.operators.metrics import metrics
from trajloom.sources.tables import event_trajectories
from trajloom.streaming.replay_stream import drain, enriched_losses, read_feed, windowed_metrics

KINDS = ["error", "view", "click"]
START = datetime(2024, 1, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    """Five files in event-time order, 100 events a minute apart in each."""
    folder = str(tmp_path / "feed")
    for part in range(5):
        rows = [
            (i, START + timedelta(minutes=i), i % 7, KINDS[i % 3], float(i % 90))
            for i in range(part * 100, part * 100 + 100)
        ]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return enriched_losses(event_trajectories(read_feed(spark, folder, schema, files_per_batch=1)))


def test_stream_equals_batch(spark, feed):
    streamed = drain(stream(spark, feed), "losses")
    batch = with_loss(enrich(event_trajectories(spark.read.parquet(feed))))
    columns = ["traj_id", "old_logps", "ratio", "weight", "loss", "reward", "capped"]
    assert sorted(streamed.select(*columns).collect()) == sorted(batch.select(*columns).collect())


def test_restart_continues_without_repeating_rows(spark, feed, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    assert drain(stream(spark, feed), "losses", out, progress).count() == 500
    spark.read.parquet(feed).where("event_id < 30").withColumn(
        "event_id", F.col("event_id") + 1000
    ).coalesce(1).write.mode("append").parquet(feed)
    assert drain(stream(spark, feed), "losses", out, progress).count() == 530


def test_closed_windows_equal_batch_metrics(spark, feed):
    found = drain(windowed_metrics(stream(spark, feed), width="1 hour", delay="10 minutes"), "windows")
    rows = {r.window_start: r for r in found.collect()}
    # 500 minutes: the watermark is at 489, so 8 whole hours are closed.
    assert sorted(rows) == [START + timedelta(hours=h) for h in range(8)]
    batch = with_loss(enrich(event_trajectories(spark.read.parquet(feed))))
    hours = metrics(batch.withColumn("hour", F.date_trunc("hour", "ts")), ["hour"])
    for row in hours.where(F.col("hour") < START + timedelta(hours=8)).collect():
        expected = row.asDict()
        hour = expected.pop("hour")
        result = {name: rows[hour][name] for name in expected}
        assert result == pytest.approx(expected)


def test_late_events_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "feed")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for minutes in ([0, 5], [200], [205], [1, 210], [400]):
        rows = [(m, START + timedelta(minutes=m), 1, "click", 4.0) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    found = drain(windowed_metrics(stream(spark, folder)), "windows").collect()
    assert {r.window_start: r.samples for r in found} == {START: 2, START + timedelta(hours=3): 3}
