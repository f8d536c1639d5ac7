"""Distinct counts on every level, and metrics kept by changes."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajloom.operators import rollups
from trajloom.operators.deltas import metric_state, metrics_of_state, snapshot_changes, updated_state
from trajloom.operators.enrich import enrich, with_loss
from trajloom.operators.metrics import metrics
from trajloom.operators.rollups import distinct_rollup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values", [40, 2000])
def test_distinct_rollup(spark, values):
    draw = random.Random(values)
    rows = [
        (draw.choice(["a", "a", "b", None]), draw.choice([1, 2, 3, None]), draw.choice(["x", ""]), draw.choice([None, *map(str, range(values))]))
        for _ in range(6000)
    ]
    df = spark.createDataFrame(rows, "d string, l int, k string, p string").repartition(7)
    got = {tuple(r[:4]): tuple(r[4:]) for r in distinct_rollup(df, ["d", "l", "k"], "p").collect()}
    want = {}
    for kept, level in ((3, 0), (2, 1), (1, 3), (0, 7)):
        for d, l, k, p in rows:
            group = (*[(d, l, k)[i] if i < kept else None for i in range(3)], level)
            samples, found = want.setdefault(group, [0, set()])
            want[group] = [samples + 1, found | ({p} - {None})]
    assert got == {g: (n, len(found)) for g, (n, found) in want.items()}


def test_more_values_than_a_bitmap_holds(spark):
    df = spark.range(100_000).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") % 70_000).alias("v"))
    got = {(r.g, r.level): (r.samples, r.distinct) for r in distinct_rollup(df, ["g"], "v").collect()}
    few = len({i % 70_000 for i in range(0, 100_000, 3)})
    many = len({i % 70_000 for i in range(100_000) if i % 3})
    assert got == {(True, 0): (33_334, few), (False, 0): (66_666, many), (None, 1): (100_000, 70_000)}


def test_distinct_rollup_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v string")
    assert [tuple(r) for r in distinct_rollup(empty, ["g"], "v").collect()] == [(None, 1, 0, 0)]
    nulls = spark.createDataFrame([("a", None)], "g string, v string")
    assert sorted(map(str, distinct_rollup(nulls, ["g"], "v").collect())) == [
        "Row(g='a', level=0, samples=1, distinct=0)", "Row(g=None, level=1, samples=1, distinct=0)",
    ]
    with pytest.raises(TypeError, match="`v` is double"):
        distinct_rollup(spark.createDataFrame([("a", 0.5)], "g string, v double"), ["g"], "v")


def test_rows_are_not_multiplied_by_levels(spark, monkeypatch):
    plans, write = [], rollups.store
    monkeypatch.setattr(rollups, "store", lambda df, name: plans.append(plan(df)) or write(df, name))
    df = spark.createDataFrame([("a", 1, "x")], "d string, l int, p string")
    plans.append(plan(distinct_rollup(df, ["d", "l"], "p")))
    assert not any("Expand" in p or "NestedLoop" in p or "Cartesian" in p for p in plans)
    # The texts are read once, as digests, and combined before the shuffle.
    assert sum("Scan ExistingRDD" in p or "LocalTableScan" in p for p in plans) == 1
    assert plans[0].count("HashAggregate") == 2


SCHEMA = "traj_id long, nll_seq double, policy_logps double, completion_len double, advantage double, origin_label string"


def trajectories(seed, n):
    draw = random.Random(seed)
    return [
        (i, draw.uniform(0, 50), -draw.uniform(0, 50), float(draw.randrange(1, 9)), draw.choice([None, draw.gauss(0, 1)]), draw.choice(["negative", "positive", None]))
        for i in range(n)
    ]


def losses(df):
    return with_loss(enrich(df))


def shown(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r]) for r in df.collect())


def test_changes_are_the_multiset_difference(spark):
    draw = random.Random(1)
    row = lambda: (draw.choice([1, 2, None]), draw.choice([0.5, float("nan"), None]), draw.choice([["a"], [], None]))
    old, new = [row() for _ in range(300)], [row() for _ in range(400)]
    kind = "a int, b double, c array<string>"
    got = snapshot_changes(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()
    want = Counter(map(repr, new))
    want.subtract(Counter(map(repr, old)))
    assert {repr(tuple(r[:3])): r._change for r in got} == {k: n for k, n in want.items() if n}
    with pytest.raises(ValueError, match="columns b"):
        snapshot_changes(spark.createDataFrame(old, kind), spark.createDataFrame([], "a int, b string, c array<string>"))


@pytest.mark.parametrize("by", [[], ["origin_label"]])
def test_a_state_follows_its_changes(spark, by):
    base = trajectories(2, 600)
    steps = [base[:400] + base[:50], base[100:] + base[200:220] * 3, [], base[5:9]]
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in steps]
    state = metric_state(losses(frames[0]), by)
    for before, after in zip(frames, frames[1:]):
        changes = snapshot_changes(before, after)
        state = updated_state(state, metric_state(losses(changes), by), by)
        full = metric_state(losses(after), by)
        if after is not frames[2]:  # to the last bit; of no rows, below
            assert sorted(map(repr, state.collect())) == sorted(map(repr, full.collect()))
        assert shown(metrics_of_state(state, by)) == shown(metrics(losses(after), by))


def test_great_and_infinite_values_leave_no_trace(spark):
    rows = losses(spark.createDataFrame(trajectories(3, 40), SCHEMA))
    odd = rows.limit(4).withColumn("reward", F.element_at(F.array(*map(F.lit, [float("nan"), float("inf"), float("-inf"), 9e13])), (F.col("traj_id") % 4 + 1).cast("int")))
    plain = metric_state(rows)
    for chosen, want in (("true", "nan"), ("reward = double('infinity')", "inf"), ("reward = double('-infinity')", "-inf")):
        part = odd.where(chosen)
        more = updated_state(plain, metric_state(part.withColumn("_change", F.lit(1).cast("bigint"))))
        assert repr(metrics_of_state(more).first().rewards_chosen) == want
        back = updated_state(more, metric_state(part.withColumn("_change", F.lit(-1).cast("bigint"))))
        assert back.collect() == plain.collect()
    with pytest.raises(Exception, match="loses more rows"):
        updated_state(plain, metric_state(rows.withColumn("_change", F.lit(-2).cast("bigint")))).collect()


def test_unchanged_rows_are_read_for_the_difference_only(spark):
    df = spark.createDataFrame(trajectories(4, 10), SCHEMA)
    text = plan(metric_state(losses(snapshot_changes(df, df)), ["origin_label"]))
    # Losses are made above the filter on changed rows; copies are combined before the shuffle.
    assert text.index("NOT (_change") > text.index("EXP(") if "EXP(" in text else "NOT (_change" in text
    assert "Join" not in text and "partial_sum" in text
