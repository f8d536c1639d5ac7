import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trajloom.operators import temporal
from trajloom.operators.mixing import first_rows, mix_by_ratio, quotas
from trajloom.operators.temporal import asof_join, interval_join, sessions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at(second):
    return None if second is None else datetime.datetime(2024, 3, 31) + datetime.timedelta(seconds=second)


@pytest.fixture(scope="module")
def hot():
    """Two thirds of all rows belong to one key; null keys, null times and ties are among them."""
    draw = random.Random(4)
    key = lambda: draw.choice([1, 1, 1, 1, draw.randrange(2, 30), None if draw.random() < 0.1 else 2])
    left = [(i, key(), draw.choice([None, *range(0, 20_000, 7)]), f"l{i}") for i in range(3000)]
    right = [(key(), draw.choice([None, *range(0, 20_000, 11)]), j) for j in range(400)]
    return left, right


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_asof_join(spark, hot, ranges):
    left, right = hot
    rows = spark.createDataFrame(left, "id long, key int, t int, note string").repartition(5)
    versions = spark.createDataFrame(right, "key int, start int, version long").repartition(3)
    got = asof_join(rows, versions, "t", "start", ["key"], "v_", ranges)
    assert got.columns == ["id", "key", "t", "note", "v_start", "v_version"]
    want = []
    for row in left:
        known = [(s, v) for k, s, v in right if row[1] is not None and k == row[1] and None not in (s, row[2]) and s <= row[2]]
        want.append((*row, *max(known, default=(None, None))))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_asof_join_by_two_keys_and_times(spark):
    rows = spark.createDataFrame([(1, "a", at(k)) for k in range(0, 100, 10)] + [(2, "a", at(5))], "x long, y string, ts timestamp")
    versions = spark.createDataFrame([(1, "a", at(25), [1, 2]), (1, "b", at(0), [3]), (3, "a", at(0), [4])], "x long, y string, since timestamp, ids array<int>")
    got = asof_join(rows, versions, "ts", "since", ["x", "y"], ranges=4).collect()
    assert len(got) == 11 and {r.ts for r in got if r.right_ids == [1, 2]} == {at(k) for k in range(30, 100, 10)}
    assert all(r.right_ids in (None, [1, 2]) for r in got)
    empty = asof_join(rows, versions.limit(0), "ts", "since", ["x", "y"]).collect()
    assert len(empty) == 11 and all(r.right_since is None for r in empty)
    assert asof_join(rows.limit(0), versions, "ts", "since", ["x", "y"]).collect() == []


def test_a_hot_key_of_an_asof_join_runs_in_many_tasks(spark, monkeypatch):
    kept, whole = [], temporal.store
    monkeypatch.setattr(temporal, "store", lambda df, name: kept.append(whole(df, name)) or kept[-1])
    rows = spark.range(30_000).select(F.lit(1).alias("key"), F.col("id").alias("t"))
    versions = spark.createDataFrame([(1, 0)], "key int, start long")
    got = asof_join(rows, versions, "t", "start", ["key"], ranges=8)
    assert got.where("right_start = 0").count() == 30_000
    per_range = kept[0].where("NOT _edge").groupBy("_range").count()
    assert per_range.count() >= 6 and per_range.agg(F.max("count")).first()[0] < 10_000
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


@pytest.mark.parametrize("limit,hot_rows", [(None, None), (0, None), (0, 50)])
def test_interval_join(spark, limit, hot_rows):
    draw = random.Random(6)
    points = [(i, draw.choice([1, 1, 1, 2, None]), draw.choice([None, *range(1000)])) for i in range(1500)]
    spans = [(j, draw.choice([1, 1, 2, None]), s := draw.randrange(1000), s + draw.choice([-1, 0, 1, 2, 5, 40, 1000, 10**6])) for j in range(120)]
    spans += [(500, 1, None, 5), (501, 1, 5, None), (502, 2, -(10**9), 10**9)]
    rows = spark.createDataFrame(points, "id long, key int, t long")
    steps = spark.createDataFrame(spans, "step long, key int, a long, b long")
    got = interval_join(rows, steps, "t", "a", "b", ["key"], broadcast_bytes=limit, hot_rows=hot_rows)
    want = sorted((i, j) for i, k, t in points for j, g, a, b in spans if None not in (k, t, a, b) and k == g and a <= t < b)
    assert sorted((r.id, r.step) for r in got.collect()) == want  # each pair once
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert interval_join(rows, steps.limit(0), "t", "a", "b", ["key"]).collect() == []


def test_interval_join_without_key_over_times(spark):
    rows = spark.createDataFrame([(k, at(k)) for k in range(0, 9000, 60)], "id long, ts timestamp_ntz")
    steps = spark.createDataFrame([(1, at(0), at(3600)), (2, at(5000), at(5000.5)), (3, at(-(10**8)), at(10**8))], "step long, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r.id, r.step) for r in interval_join(rows, steps, "ts", "a", "b").collect())
    assert got == sorted([(k, 1) for k in range(0, 3600, 60)] + [(k, 3) for k in range(0, 9000, 60)])


def test_long_intervals_lie_in_two_bins_at_most(spark, monkeypatch):
    kept, whole = [], temporal.store
    monkeypatch.setattr(temporal, "store", lambda df, name: kept.append(whole(df, name)) or kept[-1])
    steps = spark.createDataFrame([(j, 0.0, float(4**j)) for j in range(20)] + [(99, 0.3, 0.8)], "step long, a double, b double")
    rows = spark.createDataFrame([(1, 0.5)], "id long, t double")
    assert interval_join(rows, steps, "t", "a", "b").count() == 21
    assert kept[0].groupBy("step").count().agg(F.max("count")).first()[0] <= 2


def plain_sessions(rows, gap):
    out = []
    for key, second, value in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:2]):
        if out and out[-1][0] == key and second - out[-1][2] <= gap:
            out[-1] = [key, out[-1][1], second, out[-1][3] + 1, out[-1][4] + (value or 0)]
        else:
            out.append([key, second, second, 1, value or 0])
    return sorted((k, at(a), at(b), n, pytest.approx(v)) for k, a, b, n, v in out)


@pytest.mark.parametrize("ranges", [1, 4, 60])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sessions(spark, ranges, kind):
    draw = random.Random(8)
    rows = [(draw.choice(["a", "a", "a", "b", f"u{draw.randrange(9)}", None]), draw.choice([None, draw.randrange(90_000)]), draw.choice([None, 1.5, 2.0])) for _ in range(1500)]
    df = spark.createDataFrame([(k, at(s), v) for k, s, v in rows], f"user string, ts {kind}, value double").repartition(3)
    got = sorted(map(tuple, sessions(df, "user", "ts", 30, ["value"], ranges).collect()))
    assert got == plain_sessions(rows, 30)


def test_one_session_over_many_ranges(spark):
    df = spark.range(20_000).select(F.lit(7).alias("user"), F.timestamp_seconds("id").alias("ts"))
    (row,) = sessions(df, "user", "ts", 1, ranges=8).collect()
    assert (row.user, row.rows, (row.session_end - row.session_start).total_seconds()) == (7, 20_000, 19_999)
    assert sessions(df, "user", "ts", 0.5, ranges=8).count() == 20_000
    assert sessions(df.limit(0), "user", "ts", 1).collect() == []
    with pytest.raises(TypeError):
        sessions(df, "user", "user", 1)


# --- Mix ratios -----------------------------------------------------------------


def test_quotas():
    assert quotas({"a": 1, "b": 1, "c": 1}, {"a": 9, "b": 9, "c": 9}, 10) == {"a": 4, "b": 3, "c": 3}
    assert quotas({"a": 0.5, "b": 0.3, "c": 0.2}, dict.fromkeys("abc", 100), 10) == {"a": 5, "b": 3, "c": 2}
    assert quotas({"a": 3, "b": 1}, {"a": 30, "b": 1000}) == {"a": 30, "b": 10}
    assert quotas({"a": 1, "b": 0}, {"a": 5, "b": 0}) == {"a": 5, "b": 0}
    for ratios in ({}, {"a": -1}, {"a": 0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            quotas(ratios, dict.fromkeys(ratios, 5), 1)
    with pytest.raises(ValueError, match="too few"):
        quotas({"a": 1}, {"a": 5}, 6)


@pytest.mark.parametrize("parts", [1, 9])
def test_mix_by_ratio_keeps_the_smallest_keys(spark, parts):
    buffers = {name: spark.range(n).withColumn("note", F.lit(name)).repartition(parts) for name, n in (("x", 700), ("y", 500), ("z", 9))}
    got = mix_by_ratio(buffers, {"x": 2, "y": 1}, ["id"], 300, seed=5)
    key = lambda name, i: hashlib.md5(f"5:{name}:{i}".encode()).hexdigest()
    want = {(name, i) for name, n, k in (("x", 700, 200), ("y", 500, 100)) for i in sorted(range(n), key=lambda i: key(name, i))[:k]}
    rows = [(r.domain, r.id) for r in got.collect()]
    assert len(rows) == 300 and set(rows) == want
    with pytest.raises(ValueError, match="no buffer for q"):
        mix_by_ratio(buffers, {"q": 1}, ["id"])


def test_the_border_is_found_within_one_bucket(spark):
    """All keys begin alike, so the first round of counting tells nothing."""
    keys = [f"abcd{k:04x}" + "0" * 24 for k in range(300)] + ["abcd" + "ffff" + f"{k:024x}" for k in range(50)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, _key string").repartition(4)
    for k in (0, 1, 150, 300, 310, 349, 350):
        assert sorted(r["id"] for r in first_rows(df, {"abcd": 350}, k, ["id"]).collect()) == list(range(k))


def test_repeated_ids_keep_the_quota(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)], "id long, n long")
    assert mix_by_ratio({"a": df}, {"a": 1}, ["id"], 30).count() == 30
