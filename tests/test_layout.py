"""Row numbers, batches and joins: exact, whatever the partitioning and the key skew."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trajloom.operators.batching import assign_batches, training_set
from trajloom.operators.indexing import hash_positions, order_key, range_positions
from trajloom.operators.lookup import fits_broadcast, hot_keys, lookup_join, measured_bytes
from trajloom.operators.replay import group_advantage, label_origin, mix_buffers, replay_pairs
from trajloom.options import BatchOptions, TokenOptions


def md5_order(ids, epoch, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("digits", [0, 1, 4])
def test_hash_positions(spark, partitions, digits):
    df = spark.range(500).repartition(partitions).withColumn("epoch", F.lit(3))
    df = df.withColumn("k", order_key(42, F.col("epoch"), F.col("id")))
    out = hash_positions(df, "k", ["epoch"], digits).collect()
    assert {r.position: r.id for r in out} == dict(enumerate(md5_order(range(500), 3)))
    assert {r.total for r in out} == {500}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_range_positions_with_one_dominant_value(spark, partitions):
    df = spark.range(1000).withColumn("n", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 5))
    out = range_positions(df.repartition(5), [F.desc("n"), F.asc("id")], partitions).collect()
    expected = sorted(((1 if i < 700 else i % 5), i) for i in range(1000))
    expected.sort(key=lambda pair: (-pair[0], pair[1]))
    assert {r.position: r.id for r in out} == {p: i for p, (_, i) in enumerate(expected)}


def test_range_positions_of_an_empty_table(spark):
    assert range_positions(spark.range(0), [F.asc("id")]).count() == 0


def test_batches_steps_and_limit(spark):
    ids = list(range(103))
    options = BatchOptions(per_device=2, processes=3, accumulation=4, epochs=3, seed=7)
    df = spark.createDataFrame([(i,) for i in ids], "traj_id int")
    rows = assign_batches(df, "traj_id", options).collect()
    assert len(rows) == 309
    steps_per_epoch = -(-103 // 24)
    for row in rows:
        position = md5_order(ids, row.epoch, 7).index(row.traj_id)
        assert row.position == position
        assert row.batch_id == position // 6 and row.rank == position % 6 // 2
        assert row.step_id == position // 24
        assert row.global_step == row.epoch * steps_per_epoch + row.step_id
    sizes = {}
    for row in rows:
        key = (row.epoch, row.batch_id)
        sizes[key] = sizes.get(key, 0) + 1
    assert sorted(set(sizes.values())) == [1, 6]  # only the last batch is shorter
    limited = BatchOptions(2, 3, 4, 3, 7, max_steps=6)
    kept = assign_batches(df, "traj_id", limited).collect()
    assert sorted(kept) == sorted(r for r in rows if r.global_step < 6)


def test_same_batches_for_any_partitioning(spark):
    df = spark.range(200).withColumnRenamed("id", "traj_id")
    options = BatchOptions(per_device=4)
    a = sorted(assign_batches(df.repartition(1), "traj_id", options).collect())
    b = sorted(assign_batches(df.repartition(9), "traj_id", options).collect())
    assert a == b


def test_training_set_is_sorted_and_padded_by_batch(spark, tmp_path):
    from trajloom.sources.writer import save_training_set

    rows = [(i, [1] * (i % 9 + 1), [1] * (i % 9 + 1), [-100] * (i % 9 + 1)) for i in range(60)]
    df = spark.createDataFrame(
        rows, "traj_id int, input_ids array<int>, attention_mask array<int>, labels array<int>"
    )
    options = BatchOptions(per_device=4, epochs=2)
    assignment = assign_batches(df, "traj_id", options)
    out = str(tmp_path / "set")
    save_training_set(training_set(df, assignment, "traj_id", TokenOptions(), 5), out)
    back = spark.read.parquet(out).withColumn("file", F.input_file_name()).collect()
    assert len(back) == 120
    files, widths = {}, {}
    for row in back:
        files.setdefault((row.epoch, row.shard), set()).add(row.file)
        widths.setdefault((row.epoch, row.batch_id), set()).add(len(row.input_ids))
        assert row.shard == row.batch_id // 5
    assert all(len(names) == 1 for names in files.values())
    assert all(len(sizes) == 1 for sizes in widths.values())
    one = next(iter(files[(0, 0)]))
    order = [(r.batch_id, r.rank, r.position) for r in spark.read.parquet(one).collect()]
    assert order == sorted(order)


# --- Joins --------------------------------------------------------------------


def test_salted_join_equals_broadcast_join(spark):
    # Key 0 holds a third of the rows, another third has no key.
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 50)
    rows = spark.range(3000).withColumn("k", key)
    table = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    whole = sorted(lookup_join(rows, table, ["k"], ["id"], True).collect(), key=lambda r: r.id)
    salted = lookup_join(rows, table, ["k"], ["id"], False, hot_rows=100)
    assert sorted(salted.collect(), key=lambda r: r.id) == whole
    assert len(whole) == 3000
    plan = salted._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_broadcast_only_below_the_limit(spark):
    table = spark.createDataFrame([("x" * 1000, 1)], "t string, i int")
    assert 1000 < measured_bytes(table) < 1100
    assert fits_broadcast(table, 2000) and not fits_broadcast(table, 500)
    assert measured_bytes(spark.createDataFrame([([1, 2, 3],)], "a array<int>")) > 16


# --- Replay -------------------------------------------------------------------


def conversations():
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(0, 40)]
    turns += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 5, "assistant", "a"), (2, 9, "assistant", "b")]
    turns += [(3, 0, "assistant", "x"), (4, 3, "user", "only")]
    turns += [(5, 7, "user", "q"), (5, 1000, "assistant", "far")]
    turns += [(6, 0, "user", None), (6, 1, "assistant", "no prompt"), (7, 0, "user", ""), (7, 1, "assistant", "e")]
    turns += [(None, 1, "user", "nobody"), (None, 8, "assistant", "to nobody")]
    return turns


def plain_pairs(turns):
    out, groups = set(), {}
    for conv, turn, role, text in turns:
        if conv is None:
            continue
        groups.setdefault(conv, []).append((turn, role, text))
    for conv, rows in groups.items():
        rows.sort()
        for (_, before, said), (turn, role, text) in zip(rows, rows[1:]):
            if role == "assistant" and before == "user":
                out.add((conv, turn, said, text))
    return out


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_pairs_across_ranges(spark, ranges):
    df = spark.createDataFrame(conversations(), "conv_id int, turn int, role string, text string")
    out = replay_pairs(df.repartition(3), ranges=ranges).collect()
    assert {(r.group_id, r.turn, r.prompt, r.response) for r in out} == plain_pairs(conversations())
    assert len({r.traj_id for r in out}) == len(out)


def test_a_long_conversation_is_spread(spark):
    turns = spark.range(4000).selectExpr(
        "1 AS conv_id", "id * 60000 AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text"
    )
    out = replay_pairs(turns.repartition(5), ranges=16)
    assert out.count() == 2000
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert {(r.turn // 60000, r.prompt) for r in out.collect()} == {(i, f"t{i - 1}") for i in range(1, 4000, 2)}
    assert max(sizes) < 2000


def test_pairs_of_nothing(spark):
    assert replay_pairs(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).collect() == []


def test_salts_follow_the_counts(spark):
    """5000 frequent keys, one key with a third of the rows: no task takes much more than its share."""
    rows = spark.range(60_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000))
    hot = hot_keys(rows, ["k"], min_rows=100)
    threshold = 60_000 // (4 * 8)
    assert [(r.k, r._salts) for r in hot.collect()] == [(0, -(-rows.where("k = 0").count() // threshold))]
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(rows, table, ["k"], ["id"], False, hot_rows=100)
        assert joined.where("v <> 2 * k OR v IS NULL").count() == 0
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 8


def test_steps_past_the_last_epoch(spark):
    df = spark.range(10).withColumnRenamed("id", "traj_id")
    rows = assign_batches(df, "traj_id", BatchOptions(accumulation=1, epochs=1, max_steps=50)).collect()
    assert sorted(r.global_step for r in rows) == list(range(50)) and {r.epoch for r in rows} == set(range(5))
    assert len(assign_batches(df, "traj_id", BatchOptions(accumulation=1, epochs=3, max_steps=4)).collect()) == 4


@pytest.mark.parametrize("salted", [False, True])
def test_group_advantage(spark, salted):
    rewards = {0: [1.0, 0.0, 1.0, 1.0], 1: [0.1] * 7, 2: [3.0], 3: [0.5, -0.5]}
    rows = [(f"{g}:{i}", g, r) for g, values in rewards.items() for i, r in enumerate(values)]
    df = spark.createDataFrame([*rows, ("x", None, 1.0)], "traj_id string, group_id int, reward double")
    limits = {"broadcast_bytes": 0, "hot_rows": 3} if salted else {}
    out = {r.traj_id: r.advantage for r in group_advantage(df, **limits).collect()}
    for name, group, reward in rows:
        values = rewards[group]
        mean = sum(values) / len(values)
        std = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        flat = len(set(values)) == 1
        assert out[name] == (0.0 if flat else pytest.approx((reward - mean) / (std + 1e-6)))
    assert out["x"] is None


def test_origin_labels(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (2.0,), (None,)], "a double")
    out = [r[0] for r in df.select(label_origin(F.col("a"))).collect()]
    assert out == ["negative", "positive", "positive", None]


def test_mix_keeps_all_rows_and_columns(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "traj_id int, prompt string")
    b = spark.createDataFrame([(2, 0.5)], "traj_id int, advantage double")
    out = mix_buffers({"math": a, "code": b}).collect()
    assert sorted(r.domain for r in out) == ["code", "math", "math"]
    assert {"prompt", "advantage"} <= set(out[0].asDict())
