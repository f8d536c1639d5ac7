"""Scoring and the gradient step against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajloom.functions.tokens import log_softmax_at
from trajloom.operators.enrich import enrich
from trajloom.operators.policy import (
    fit_policy,
    logits_scores,
    _summed_in_place,
    counted_samples,
    policy_update,
    score_tokens,
    sequence_nll,
    sequence_scores,
    softmax_policy,
    train_policy,
    unigram_logits,
)
from trajloom.operators.userfn import encode_with, map_batches, map_rows, score_rows, score_with
from trajloom.options import LossOptions, TokenOptions
from trajloom.plans.training_run import scored_losses
from pyspark.sql import types as T

M = -100
SCHEMA = "traj_id int, input_ids array<int>, attention_mask array<int>, labels array<int>, reward double"


def make_rows(count=40, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(count):
        prompt = [rng.randint(4, 9) for _ in range(rng.randint(0, 4))]
        # Token 4 takes about half of all places.
        reply = [4 if rng.random() < 0.5 else rng.randint(4, 12) for _ in range(rng.randint(0, 8))]
        ids = prompt + reply
        rows.append((i, ids, [1] * len(ids), [M] * len(prompt) + reply, float(i % 3)))
    rows.append((count, [], [], [], 1.0))
    return rows


ROWS = make_rows()


def scored(row):
    _, ids, _, labels, _ = row
    return [(ids[p - 1], labels[p]) for p in range(1, len(ids)) if labels[p] != M]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("salted", [False, True])
@pytest.mark.parametrize("bigram", [False, True])
def test_scores_match_plain_python(spark, table, bigram, salted):
    vocab, k = 20, 0.5
    train, test = table.where("traj_id < 25"), table
    policy = fit_policy(train, vocab, bigram, k)
    pairs = [pair for row in ROWS[:25] for pair in scored(row)]

    def logp(prev, token):
        context = [t for p, t in pairs if p == prev or not bigram]
        return math.log((context.count(token) + k) / (len(context) + k * vocab))

    limits = {"broadcast_bytes": 0, "hot_rows": 5} if salted else {}
    tokens = score_tokens(test, policy, **limits)
    out = {r.traj_id: r for r in sequence_scores(tokens).collect()}
    nll = {r.traj_id: r.nll_seq for r in sequence_nll(tokens).collect()}
    assert len(out) == len(ROWS)
    for row in ROWS:
        expected = [logp(*pair) for pair in scored(row)]
        assert out[row[0]].policy_logps == pytest.approx(sum(expected), abs=1e-9)
        assert out[row[0]].completion_len == max(len(expected), 1)
        assert out[row[0]].scored_tokens == len(expected)
        assert nll[row[0]] == pytest.approx(-sum(expected), abs=1e-9)


def test_weighted_counts(table):
    found = {r.token: r.n for r in fit_policy(table, 20, weight="reward").counts.collect()}
    expected = {}
    for row in ROWS:
        for _, token in scored(row):
            expected[token] = expected.get(token, 0.0) + row[4]
    assert found == pytest.approx(expected)


def test_unseen_tokens_without_smoothing(spark, table):
    policy = fit_policy(table.where("traj_id = 0"), 20, smoothing=0.0)
    scores = [r.token_logp for r in score_tokens(table, policy).where("token = 12").collect()]
    assert scores and all(s == -math.inf for s in scores) or policy.counts.where("token = 12").count()


def test_softmax_of_counts_is_the_smoothed_policy(table):
    words = table.sparkSession.range(4, 30).withColumnRenamed("id", "token_id")
    policy = fit_policy(table, 26, smoothing=0.5)
    softmax = {r.token: r.logp for r in softmax_policy(unigram_logits(policy, words)).collect()}
    assert len(softmax) == 26 and sum(map(math.exp, softmax.values())) == pytest.approx(1)
    scores = score_tokens(table, policy).where("token is not null").collect()
    assert scores and all(r.token_logp == pytest.approx(softmax[r.token]) for r in scores)
    with pytest.raises(ValueError):
        softmax_policy(unigram_logits(policy, words).where("false"))
    with pytest.raises(ValueError, match="smoothing"):
        unigram_logits(fit_policy(table, 26, smoothing=0.0), words)


def test_gradients_sum_to_zero_and_unknown_tokens_fail(spark):
    _, samples = samples_for(spark)
    theta = spark.createDataFrame([(t, 0.1 * t) for t in range(4, 14)], "token int, theta double")
    out = policy_update(samples, theta, 0.5).collect()
    assert sum(r.gradient for r in out) == pytest.approx(0, abs=1e-9)
    with pytest.raises(Exception, match="no logit for token 4"):
        policy_update(samples, theta.where("token > 4"), 0.5).collect()


def test_both_forms_of_the_step_agree(spark):
    """Also with rows without tokens; only the form by join shuffles rows by their number."""
    _, samples = samples_for(spark)
    bare = samples.limit(1).withColumns({c: F.expr(f"filter({c}, x -> false)") for c in ("input_ids", "labels")})
    samples = samples.unionByName(bare)
    theta = spark.createDataFrame([(t, 0.1 * t) for t in range(4, 14)], "token int, theta double")
    near, far = ({r.token: r.gradient for r in policy_update(samples, theta, 0.5, **o).collect()} for o in ({}, {"broadcast_bytes": 0}))
    assert near == pytest.approx(far) and len(near) == 10
    with pytest.raises(Exception, match="no logit for token 4"):
        policy_update(samples, theta.where("token > 4"), 0.5, broadcast_bytes=0).collect()
    rows = counted_samples(samples)
    table = softmax_policy(theta).select("token", F.col("logp").alias("token_logp"))
    assert "Exchange" not in _summed_in_place(rows, table)._jdf.queryExecution().executedPlan().toString()


def test_equal_ids_do_not_matter_to_the_gradient(spark):
    _, samples = samples_for(spark)
    theta = spark.createDataFrame([(t, 0.1 * t) for t in range(4, 14)], "token int, theta double")
    same = samples.withColumn("traj_id", F.lit(None).cast("int"))
    first, second = ({r.token: r.gradient for r in policy_update(s, theta, 0.5).collect()} for s in (samples, same))
    assert first == pytest.approx(second)


def samples_for(spark):
    rng = random.Random(5)
    rows = [
        (*row[:4], rng.uniform(2, 30), rng.uniform(-1, 1), rng.choice(["negative", "positive"]))
        for row in ROWS
    ]
    schema = SCHEMA.replace("reward double", "nll_seq double, advantage double, origin_label string")
    return rows, enrich(spark.createDataFrame(rows, schema))


def mean_loss(rows, theta, options, frozen):
    """Loss at ``theta`` with the ratios of ``frozen``, as the gradient sees it."""
    def logp_of(table):
        z = math.log(sum(math.exp(v) for v in table.values()))
        return {t: v - z for t, v in table.items()}

    now, then, total = logp_of(theta), logp_of(frozen), 0.0
    for _, ids, _, labels, nll, advantage, origin in rows:
        tokens = [t for _, t in scored((0, ids, 0, labels, 0))]
        size = max(len(tokens), 1) if options.length_normalize else 1
        log_ratio = (sum(then[t] for t in tokens) + nll) / size
        ratio = math.exp(min(log_ratio, math.log(options.clip_ratio_max)))
        weight = min(ratio, options.alpha) if origin == "negative" else 1.0
        total += -advantage * weight * sum(now[t] for t in tokens) / size
    return total / len(rows)


@pytest.mark.parametrize("options", [LossOptions(), LossOptions(length_normalize=True, alpha=3.0)])
@pytest.mark.parametrize("salted", [False, True])
def test_gradient_by_finite_differences(spark, options, salted):
    rows, samples = samples_for(spark)
    theta = {t: 0.1 * t for t in range(4, 14)}
    table = spark.createDataFrame(list(theta.items()), "token int, theta double")
    limits = {"broadcast_bytes": 0, "hot_rows": 5} if salted else {}
    out = policy_update(samples, table, 0.5, options, **limits).collect()
    assert len(out) == len(theta)
    step = 1e-5
    for row in out:
        up, down = dict(theta), dict(theta)
        up[row.token] += step
        down[row.token] -= step
        slope = mean_loss(rows, up, options, theta) - mean_loss(rows, down, options, theta)
        assert row.gradient == pytest.approx(slope / (2 * step), abs=1e-7)
        assert row.new_theta == pytest.approx(row.theta - 0.5 * row.gradient)


def test_training_lowers_the_loss(spark):
    rows, samples = samples_for(spark)
    options = LossOptions(use_dataset_advantage=False)
    rows = [(*row[:5], 1.0, "positive") for row in rows]
    samples = samples.withColumn("origin_is_negative", F.lit(0.0))
    theta = {t: 0.0 for t in range(4, 14)}
    table = spark.createDataFrame(list(theta.items()), "token int, theta double")
    after = {r.token: r.theta for r in train_policy(samples, table, 0.2, 2, options).collect()}
    assert mean_loss(rows, after, options, after) < mean_loss(rows, theta, options, theta)


def test_scores_reach_the_loss(spark, table):
    tokens = table.withColumn("nll_seq", F.lit(3.0)).withColumn("advantage", F.lit(1.0))
    scores = sequence_scores(score_tokens(tokens, fit_policy(table, 20)))
    rows = scored_losses(tokens, scores).collect()
    assert len(rows) == len(ROWS)
    assert all(r.loss == pytest.approx(-r.policy_logps) for r in rows)


# --- Logits and user models ---------------------------------------------------


def model():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(13, 13)) * 20
    return lambda ids, mask: table[ids]


def longer_model():
    inner = model()
    return lambda ids, mask: np.concatenate([np.full((len(ids), 2, 13), 7.0), inner(ids, mask)], axis=1)


def make_model():
    return model()


def make_longer_model():
    return longer_model()


def plain_score(row):
    logits, total = model()(np.asarray([row[1]], dtype=int), None)[0], 0.0
    for p in range(1, len(row[1])):
        if row[3][p] != M:
            x = logits[p - 1]
            total += x[row[3][p]] - (x.max() + math.log(np.exp(x - x.max()).sum()))
    return total


@pytest.mark.parametrize("factory", [make_model, make_longer_model])
def test_user_model(spark, table, factory):
    tokens = score_with(table, factory, batch_rows=3)
    for r in tokens.collect():
        assert r.pos is None or ROWS[r.traj_id][3][r.pos] == r.token
    out = {r.traj_id: r for r in sequence_scores(tokens).collect()}
    assert len(out) == len(ROWS)
    for row in ROWS:
        assert out[row[0]].policy_logps == pytest.approx(plain_score(row), abs=1e-9)
        assert out[row[0]].completion_len == max(len(scored(row)), 1)


@pytest.mark.parametrize("skipped", [None, 2])
def test_long_logits(spark, skipped):
    logits, targets = [], []
    for row in ROWS:
        values = (model() if skipped is None else longer_model())(np.asarray([row[1]], dtype=int), None)[0]
        logits += [(row[0], p, t, float(x), skipped) for p, line in enumerate(values) for t, x in enumerate(line)]
        targets += [(row[0], p, row[3][p]) for p in range(1, len(row[1])) if row[3][p] != M]
    long = spark.createDataFrame(logits, "traj_id int, pos int, token int, logit double, skipped int")
    wanted = spark.createDataFrame(targets, "traj_id int, pos int, token int")
    shift = None if skipped is None else "skipped"
    out = logits_scores(long, wanted, shift).collect()
    assert len(out) == len(targets)
    shuffled = logits_scores(long, wanted, shift, broadcast_bytes=0).collect()
    by_place = [{(r.traj_id, r.pos, r.token): r.token_logp for r in rows} for rows in (out, shuffled)]
    assert by_place[0] == pytest.approx(by_place[1])
    with pytest.raises(Exception, match="no logit"):
        logits_scores(long.where("token <> 4"), wanted, shift).count()
    with pytest.raises(Exception, match="no logit"):
        logits_scores(long.where("traj_id > 5"), wanted, shift).count()
    sums = {}
    for r in out:
        sums[r.traj_id] = sums.get(r.traj_id, 0.0) + r.token_logp
    for row in ROWS:
        assert sums.get(row[0], 0.0) == pytest.approx(plain_score(row), abs=1e-9)


def test_long_logits_of_any_size(spark):
    values = [-2000.0, 1999.0, 2000.0, 1400.0, 0.0]
    logits = spark.createDataFrame([(1, 0, t, v) for t, v in enumerate(values)], "traj_id int, pos int, token int, logit double")
    wanted = spark.createDataFrame([(1, 1, t) for t in range(5)], "traj_id int, pos int, token int")
    found = {r.token: r.token_logp for r in logits_scores(logits, wanted).collect()}
    norm = 2000 + math.log(1 + math.exp(-1))
    assert found == pytest.approx({t: v - norm for t, v in enumerate(values)})


def test_span_that_starts_at_zero_skips_its_first_token():
    flat = lambda ids, mask: np.zeros((*ids.shape, 4))
    row, pos, token, logp = score_rows(flat, [[1, 2, 3], [1], []], [[1] * 3, [1], []], [[1, 2, 3], [1], []], TokenOptions())
    assert (row, pos.to_pylist(), token.to_pylist()) == ([0, 0, 1, 2], [1, 2, None, None], [2, 3, None, None])
    assert logp.to_pylist() == [pytest.approx(math.log(0.25))] * 2 + [None] * 2


def add_note(row, suffix):
    return {"note": None if row["n"] is None else f"{row['n']}{suffix}", "n": row["n"]}


def test_row_map_keeps_nulls_and_types(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, None, "y")], "traj_id int, n int, gone string")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("note", T.StringType())])
    out = map_rows(df, add_note, schema, {"suffix": "!"}, ["gone"])
    assert out.columns == ["traj_id", "n", "note"]
    assert sorted(map(tuple, out.collect())) == [(1, 5, "5!"), (2, None, None)]


def make_encoder():
    return lambda text: [len(word) for word in text.split()]


def test_user_encoder(spark):
    df = spark.createDataFrame([(1, "a bb", "")], "traj_id int, prompt string, response string")
    row = encode_with(df, make_encoder, ["prompt", "response"]).first()
    assert (row.prompt_ids, row.response_ids) == ([1, 2], [])


def in_order(rows):
    return [{"batch": rows[0]["batch"], "ids": [r["id"] for r in rows]}]


def test_batch_function_sees_rows_by_position(spark):
    df = spark.range(100).withColumns({"batch": F.col("id") % 9, "position": -F.col("id")}).repartition(5)
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
    out = {r.batch: r.ids for r in map_batches(df, in_order, schema, ["batch"]).collect()}
    assert out == {b: list(range(b, 100, 9))[::-1] for b in range(9)}


def join_ids(rows):
    return [{"batch": rows[0]["batch"], "ids": sorted(r["id"] for r in rows)}]


def test_batch_function_sees_whole_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).withColumn("batch", F.col("id") % 9)
        schema = T.StructType(
            [T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))]
        )
        out = {r.batch: r.ids for r in map_batches(df, join_ids, schema, ["batch"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {b: list(range(b, 100, 9)) for b in range(9)}


def test_masked_and_odd_logits_in_both_forms(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, -inf, 2.0], 0), (2, [1.0, -inf, 2.0], 1), (3, [-inf, -inf], 0), (4, [inf, 1.0], 1), (5, [nan, 1.0], 1),
        (6, [-3000.0, 4000.0, -inf], 0), (7, [5.0], 0), (8, [700.0, -inf, 701.0], 2),
    ]
    df = spark.createDataFrame(rows, "traj_id long, logits array<double>, target int")
    cells = df.select("traj_id", F.lit(0).alias("pos"), F.posexplode("logits").alias("token", "logit"))
    targets = df.select("traj_id", F.lit(1).alias("pos"), F.col("target").alias("token"))
    long = {r.traj_id: r.token_logp for r in logits_scores(cells, targets).collect()}
    array = {r.traj_id: r.p for r in df.select("traj_id", log_softmax_at(F.col("logits"), F.col("target")).alias("p")).collect()}
    want = {1: 1 - math.log(math.exp(1) + math.exp(2)), 2: -inf, 3: nan, 4: nan, 5: nan, 6: -7000.0, 7: 0.0, 8: -math.log1p(math.exp(-1))}
    for found in (long, array):
        assert found == {k: pytest.approx(v, nan_ok=True) for k, v in want.items()}


def test_a_target_beyond_the_vocabulary_is_an_error_in_both_forms(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 2)], "traj_id long, logits array<double>, target int")
    cells = df.select("traj_id", F.lit(0).alias("pos"), F.posexplode("logits").alias("token", "logit"))
    targets = df.select("traj_id", F.lit(1).alias("pos"), F.col("target").alias("token"))
    for query in (logits_scores(cells, targets), df.select(log_softmax_at(F.col("logits"), F.col("target")))):
        with pytest.raises(Exception, match="a target has no logit"):
            query.collect()
    nulls = spark.createDataFrame([(None, 1), ([1.0], None)], "logits array<double>, target int")
    assert [r[0] for r in nulls.select(log_softmax_at(F.col("logits"), F.col("target"))).collect()] == [None, None]


def test_a_user_encoder_changes_no_other_column(spark):
    df = spark.createDataFrame([(2**53 + 1, "ab", None), (None, "", 1.5)], "id long, text string, x double")
    rows = encode_with(df, make_encoder, ["text"]).collect()
    assert [(r["id"], r.text, r.x) for r in rows] == [(2**53 + 1, "ab", None), (None, "", 1.5)]
    with pytest.raises(Exception, match="column text holds a null text"):
        encode_with(spark.createDataFrame([(None,)], "text string"), make_encoder, ["text"]).collect()
