"""Loss, labels and metrics against worked examples and a plain-Python loss."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trajloom.functions.casts import float_text
from trajloom.operators.enrich import enrich, with_loss, with_old_logps
from trajloom.operators.metrics import last_metrics, metrics, metrics_rollup, with_prefix
from trajloom.options import LossOptions

SCHEMA = (
    "traj_id int, policy_logps double, old_logps double, completion_len double, "
    "advantage double, origin_is_negative double"
)

# pol, old, len, advantage, flag, options, ratio, w, weight, loss, reward, capped
GOLDEN = [
    (-10, -12, 4, 1.0, 0, {}, 7.389056, 1, 1, 10.0, 0.5, True),
    (-12, -10, 4, -1.0, 1, {}, 0.135335, 0.135335, 0.135335, -1.624023, -0.5, False),
    (-10, -12, 4, -1.0, 1, {}, 7.389056, 1, 1, -10.0, 0.5, True),
    (-12, -10, 4, -0.5, 0, {}, 0.135335, 0.135335, 1, -6.0, -0.5, False),
    (0, -123.456, 1, 1.0, 0, {}, 10.0, 1, 1, 0, 123.456, True),
    (-10, -10, 4, -1.0, 1, {}, 1, 1, 1, -10.0, 0, True),
    (-12, -10, 4, -1.0, 1, {"length_normalize": True}, 0.606531, 0.606531, 0.606531, -1.819592, -0.5, False),
    (-10, -12, 4, -1.0, 1, {"alpha": 5.0}, 7.389056, 5, 5, -50.0, 0.5, True),
    (-5, -12, 4, -1.0, 1, {"alpha": 20.0}, 10.0, 10, 10, -50.0, 1.75, False),
    (-12, -10, 4, 9.0, 1, {"use_dataset_advantage": False, "default_advantage": 2.0},
     0.135335, 0.135335, 0.135335, 3.248047, -0.5, False),
]


def samples(spark, rows):
    return spark.createDataFrame(
        [(i, *[None if v is None else float(v) for v in row]) for i, row in enumerate(rows)], SCHEMA
    )


@pytest.mark.parametrize("row", GOLDEN)
def test_golden_rows(spark, row):
    out = with_loss(samples(spark, [row[:5]]), LossOptions(**row[5])).first()
    found = (out.ratio, out.w, out.weight, out.loss, out.reward)
    assert found == pytest.approx(row[6:11], abs=1e-6)
    assert out.capped is row[11]


def test_golden_batch(spark):
    out = metrics(with_loss(samples(spark, [row[:5] for row in GOLDEN[:4]]))).first().asDict()
    expected = {
        "samples": 4, "loss": -1.906006, "ratio_mean": 3.762196, "w_mean": 0.567668,
        "weight_mean": 0.783834, "frac_capped": 0.5, "completion_len_mean": 4, "old_logp_mean": -11,
        "data_advantage_mean": -0.375, "frac_origin_negative": 0.5, "rewards_chosen": 0,
        "logps_chosen": -11, "length_normalize": 0,
    }
    assert out == pytest.approx(expected, abs=1e-6)


def test_nan_spreads_and_is_never_capped(spark):
    nan = float("nan")
    out = with_loss(samples(spark, [(nan, -1, 2, 1, 1), (-1, -1, 2, nan, 0), (-1, -1, 2, 1, nan)])).collect()
    assert math.isnan(out[0].ratio) and math.isnan(out[0].weight) and math.isnan(out[0].loss)
    assert out[0].capped is False
    assert math.isnan(out[1].loss) and out[1].weight == 1.0
    assert out[2].weight == 1.0  # a NaN flag is not above one half
    share = metrics(with_loss(samples(spark, [(-1, -1, 2, 1, nan), (-1, -1, 2, 1, 1)]))).first()
    assert share.frac_origin_negative == 0.5


def test_infinite_log_ratios(spark):
    inf = float("inf")
    rows = with_loss(samples(spark, [(-1, -inf, 2, 1, 1), (-inf, -1, 2, 1, 1)])).collect()
    assert rows[0].ratio == 10.0 and rows[1].ratio == 0.0


def test_missing_advantage_and_flag_columns(spark):
    df = samples(spark, [(-12, -10, 4, 5, 1)]).drop("advantage", "origin_is_negative")
    out = with_loss(df).first()
    assert (out.weight, out.advantage_used, out.loss) == (1.0, 1.0, 12.0)
    assert "frac_origin_negative" not in metrics(with_loss(df)).columns


def test_clip_must_be_positive():
    with pytest.raises(ValueError):
        LossOptions(clip_ratio_max=0.0)


def plain_loss(pol, old, length, advantage, negative, o: LossOptions):
    by = length if o.length_normalize else 1.0
    ratio = math.exp(min(pol / by - old / by, math.log(o.clip_ratio_max)))
    weight = min(max(ratio, 0.0), o.alpha) if negative else 1.0
    gain = advantage if o.use_dataset_advantage else o.default_advantage
    return -gain * weight * pol / by, weight


number = st.floats(-200, 0, allow_nan=False)
trajectory = st.tuples(
    number, number, st.integers(1, 500), st.floats(-5, 5, allow_nan=False), st.booleans()
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(trajectory, min_size=1, max_size=30),
    st.builds(
        LossOptions, alpha=st.floats(0.1, 20), clip_ratio_max=st.floats(0.5, 50),
        length_normalize=st.booleans(), use_dataset_advantage=st.booleans(),
    ),
)
def test_matches_plain_python(spark, rows, options):
    out = with_loss(samples(spark, rows), options).orderBy("traj_id").collect()
    for row, found in zip(rows, out):
        loss, weight = plain_loss(*row, options)
        assert found.loss == pytest.approx(loss, rel=1e-9, abs=1e-12)
        assert found.weight == pytest.approx(weight, rel=1e-9)
        assert 0 <= found.weight <= max(1.0, options.alpha)


def test_positive_losses_do_not_depend_on_the_behaviour_policy(spark):
    a = with_loss(samples(spark, [(-7, -1, 3, 2, 0)])).first()
    b = with_loss(samples(spark, [(-7, -90, 3, 2, 0)]), LossOptions(alpha=9.0, clip_ratio_max=2.0)).first()
    assert a.loss == b.loss == 14.0


# --- Labels and numbers -------------------------------------------------------

LABELS = [
    ("negative", 1.0), (" Negative\n", 1.0), ("NEGATIVE", 1.0), ("\tnegative\u00a0", 1.0),
    ("\x1cnegative\x85", 1.0), ("\u3000negative\u2028", 1.0), ("positive", 0.0), ("neg", 0.0),
    ("1", 0.0), ("", 0.0), (None, 0.0), ("negative.", 0.0),
]


def test_text_labels(spark):
    df = spark.createDataFrame([(1.0, text) for text, _ in LABELS], "nll_seq double, origin_label string")
    assert [r.origin_is_negative for r in enrich(df).collect()] == [flag for _, flag in LABELS]


def test_python_agrees_on_text_labels():
    assert [1.0 if t and t.strip().lower() == "negative" else 0.0 for t, _ in LABELS] == [f for _, f in LABELS]


@pytest.mark.parametrize(
    "kind, values, counted",
    [
        ("int", [1, 0, -1, None], [True, False, False, False]),
        ("double", [0.5, 0.7, float("nan"), None], [False, True, False, False]),
        ("boolean", [True, False, None], [True, False, False]),
        ("date", [None], [False]),
    ],
)
def test_other_labels_are_the_flag_itself(spark, kind, values, counted):
    df = spark.createDataFrame([(1.0, v) for v in values], f"nll_seq double, origin_label {kind}")
    rows = with_loss(
        enrich(df).withColumn("policy_logps", F.lit(-5.0)).withColumn("completion_len", F.lit(1.0))
    ).collect()
    assert [r.weight != 1.0 for r in rows] == counted


TEXTS = ["1", " 1.5\n", "-2e3", ".5", "5.", "1_000", "1__0", "_1", "1d", "1f", "0x1", "inf", "-Infinity",
         "+nan", "NaN", "", " ", "abc", "1e", "1,5", "+.5e-2", "1e400"]


def test_float_text_follows_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", float_text(F.col("t")).alias("v"))
    for row in rows.collect():
        try:
            expected = float(row.t)
        except ValueError:
            expected = None
        if expected is not None and math.isnan(expected):
            assert math.isnan(row.v), row.t
        else:
            assert row.v == expected, row.t


def test_advantage_defaults(spark):
    df = spark.createDataFrame([(1.0, "0.5"), (1.0, "none"), (1.0, None)], "nll_seq double, advantage string")
    assert [r.advantage for r in enrich(df, LossOptions(default_advantage=3.0)).collect()] == [0.5, 3.0, 3.0]
    assert enrich(df.drop("advantage"), LossOptions(default_advantage=3.0)).first().advantage == 3.0


# --- Strict and lenient NLL ---------------------------------------------------


def test_strict_null_nll_fails_even_when_nobody_reads_it(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "traj_id int, nll_seq double")
    with pytest.raises(PySparkException, match="nll_seq"):
        with_old_logps(df).count()
    with pytest.raises(PySparkException, match="nll_seq"):
        enrich(df).select("traj_id").collect()


def test_lenient_nll(spark):
    lenient = LossOptions(require_old_nll=False)
    df = spark.createDataFrame([(1.5,), (None,)], "nll_seq double")
    assert [r.old_logps for r in with_old_logps(df, lenient).collect()] == [-1.5, 0.0]
    bad = spark.createDataFrame([("x",)], "nll_seq string")
    with pytest.raises(PySparkException, match="not a number"):
        with_old_logps(bad, lenient).collect()
    known = spark.createDataFrame([(-2.0,), (None,)], "old_logps double")
    assert [r.old_logps for r in with_old_logps(known, lenient).collect()] == [-2.0, 0.0]


def test_missing_nll_column(spark):
    with pytest.raises(ValueError, match="nll_seq"):
        enrich(spark.createDataFrame([(1,)], "prompt int"))


# --- Metric tables ------------------------------------------------------------


def test_last_metrics_keeps_the_last_call_of_the_first_device(spark):
    rows = [(0, 0, 0, 0, 1.0), (0, 0, 1, 0, 2.0), (0, 0, 1, 1, 9.0), (0, 1, 2, 0, 3.0)]
    df = spark.createDataFrame(rows, "epoch int, step_id int, batch_id int, rank int, loss double")
    out = {r.step_id: (r.batch_id, r.loss) for r in last_metrics(df, ["epoch", "step_id"]).collect()}
    assert out == {0: (1, 2.0), 1: (2, 3.0)}


def test_rollup_total_equals_global_metrics(spark):
    df = with_loss(samples(spark, [row[:5] for row in GOLDEN])).withColumn("domain", F.col("traj_id") % 3)
    total = metrics_rollup(df, ["domain", "capped"]).where("level = 3").drop("domain", "capped", "level")
    assert total.first().asDict() == pytest.approx(metrics(df).first().asDict())


def test_prefix(spark):
    df = with_prefix(metrics(with_loss(samples(spark, [GOLDEN[0][:5]]))), "eval_", ["samples"])
    assert "eval_loss" in df.columns and "samples" in df.columns and "loss" not in df.columns


def test_metrics_of_an_empty_table(spark):
    out = metrics(with_loss(samples(spark, []))).first()
    assert out.samples == 0 and out.loss is None
