"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Numbers are rounded to six places and token lists shown as text, so that results
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.functions.tokens import completion_span, log_softmax_at
from trajloom.operators.batching import BATCH_KEYS, assign_batches, pad_batches, training_set
from trajloom.operators.deltas import metric_state, metrics_of_state, snapshot_changes, updated_state
from trajloom.operators.enrich import apply_template, enrich, model_batch, preview, with_loss
from trajloom.operators.metrics import (
    last_metrics,
    metrics,
    metrics_rollup,
    scoreboard,
    split_counts,
    with_prefix,
)
from trajloom.operators.mixing import mix_by_ratio
from trajloom.operators.policy import (
    TabularPolicy,
    fit_policy,
    logits_scores,
    policy_update,
    score_tokens,
    sequence_nll,
    sequence_scores,
    softmax_policy,
    train_policy,
    unigram_logits,
)
from trajloom.operators.replay import group_advantage, label_origin, mix_buffers, replay_pairs
from trajloom.operators.rollups import distinct_rollup
from trajloom.operators.store import new_path, store
from trajloom.operators.table_functions import register_batch_function
from trajloom.operators.temporal import asof_join, interval_join, sessions
from trajloom.operators.tokenise import build_vocabulary, encode, truncation_audit, with_model_inputs
from trajloom.operators.userfn import encode_with, map_batches, map_rows, score_with
from trajloom.options import BOS_ID, EOS_ID, PAD_ID, BatchOptions, LossOptions, TokenOptions
from trajloom.plans.training_run import batch_metrics, preview_rows, scored_losses, tokenised
from trajloom.sources.datasource import register_source
from trajloom.sources.reader import prune, read_trajectories
from trajloom.sources.tables import (
    event_trajectories,
    line_trajectories,
    numeric_trajectories,
    scored_text_trajectories,
    table,
    text_trajectories,
    with_reward,
)
from trajloom.sources.writer import save_metrics, save_training_set
from trajloom.streaming.sessions import drain_with_fates, new_paths, stream_pairs
from trajloom.streaming.replay_stream import drain, enriched_losses, read_feed, windowed_metrics

Query = Callable[[SparkSession, str], DataFrame]

TEXT = ["prompt", "response"]
LIMITS = TokenOptions(max_length=256, max_prompt_length=96, bos_token_id=BOS_ID, eos_token_id=EOS_ID)
KEEP_START = TokenOptions(
    max_length=256, max_prompt_length=96, truncation_mode="keep_start", bos_token_id=BOS_ID
)
PADDED = TokenOptions(bos_token_id=BOS_ID, pad_token_id=PAD_ID)
# As in the full training script: 4 rows on each of 4 devices, 8 calls per step.
RUN = BatchOptions(per_device=4, processes=4, accumulation=8, epochs=2)
SMOOTHING = 1.0
LOSS = ["ratio", "w", "weight", "coef", "loss", "reward"]


def shown(column: Column) -> Column:
    return F.concat_ws(" ", column.cast("array<string>"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the doubles; adding 0 turns a negative zero into a plain one."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = (F.round(column, places) + F.lit(0.0)).alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.BooleanType)):
            column = column.cast("bigint").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def losses(df: DataFrame, options: LossOptions = LossOptions()) -> DataFrame:
    return with_loss(enrich(df, options), options)


# --- Loss and metrics ---------------------------------------------------------


def sample_loss(options: LossOptions) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = losses(numeric_trajectories(spark, sf_dir), options)
        return rounded(rows.select("traj_id", "old_logps", "advantage_used", *LOSS, "capped"))

    return query


def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics(losses(numeric_trajectories(spark, sf_dir))))


def global_metrics_length_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = LossOptions(length_normalize=True)
    return rounded(metrics(losses(numeric_trajectories(spark, sf_dir), options), None, options))


def metrics_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics(losses(numeric_trajectories(spark, sf_dir)), ["origin_label"]))


def metrics_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics(losses(scored_text_trajectories(spark, sf_dir))))


def mixed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric = numeric_trajectories(spark, sf_dir).withColumn("traj_id", F.col("traj_id").cast("string"))
    events = event_trajectories(table(spark, sf_dir, "events")).drop("ts")
    return mix_buffers(
        {
            "text": scored_text_trajectories(spark, sf_dir),
            "numeric": numeric,
            "events": events.withColumn("traj_id", F.col("traj_id").cast("string")),
        }
    )


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses(mixed_domains(spark, sf_dir))
    flagged = rows.withColumn(
        "origin", F.when(F.col("origin_is_negative") > 0.5, "negative").otherwise("positive")
    )
    return rounded(metrics_rollup(flagged, ["domain", "origin"]))


def distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prompts per domain and label on every level; documents stand for prompts."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), F.col("source").alias("label"), F.col("text").alias("prompt"))
    return distinct_rollup(rows, ["domain", "label"], "prompt", "prompts")


def delta_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a buffer that loses its oldest rows, gains new ones and has others revised.

    Losses are computed for all rows of the first snapshot once, then for what has changed.
    """
    lines, by = table(spark, sf_dir, "lineitem"), ["origin_label"]
    old = line_trajectories(lines.where("l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    new = line_trajectories(lines.where("l_shipdate >= TIMESTAMP_NTZ '1993-01-01 00:00:00'"))
    halved = F.when(F.col("completion_len") >= 40, F.col("advantage") / 2).otherwise(F.col("advantage"))
    state = store(metric_state(losses(old), by), "metric-state")
    changes = snapshot_changes(old, new.withColumn("advantage", halved))
    return rounded(metrics_of_state(updated_state(state, metric_state(losses(changes), by), by), by))


def expert_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_domains(spark, sf_dir).groupBy("domain").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count("prompt").alias("prompts"),
        F.count("advantage").alias("advantages"),
        F.round(F.sum("nll_seq"), 4).alias("nll_sum"),
    )


def mixed_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three types in the ratio 3 : 2 : 1, a tenth as many as there are events."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kinds = {"click": 3, "view": 2, "purchase": 1}
    buffers = {kind: events.where(F.col("event_type") == kind).drop("event_type") for kind in kinds}
    return mix_by_ratio(buffers, kinds, ["event_id"], total=events.count() // 60 * 6)


def asof_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trajectory with the policy version of its user that was valid at its time."""
    events = table(spark, sf_dir, "events")
    rows = events.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    versions = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("valid_from"), F.col("event_id").alias("version"))
    return asof_join(rows, versions, "ts", "valid_from", ["user_id"], "policy_")


def interval_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the training steps of their user that cover them; some steps are very long."""
    events = table(spark, sf_dir, "events")
    hours = F.when(F.col("event_id") % 50 == 0, F.lit(9600)).otherwise(F.ceil("value").cast("int"))
    steps = events.where("event_type = 'signup'").select(
        F.col("event_id").alias("step_id"), "user_id", F.col("ts").alias("step_start"), (F.col("ts") + F.make_dt_interval(hours=hours)).alias("step_end")
    )
    rows = events.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    return interval_join(rows, steps, "ts", "step_start", "step_end", ["user_id"]).select("step_id", "event_id")


def session_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory per session of a user: events no more than eight hours apart."""
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", 8 * 3600, ["value"])
    return found.select("user_id", "session_start", "session_end", "rows", F.round("value", 4).alias("reward"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics under the prefix they carry outside training."""
    result = metrics(losses(numeric_trajectories(spark, sf_dir)), ["origin_label"])
    return rounded(with_prefix(result, "eval_", ["origin_label", "samples"]))


# --- Columns ------------------------------------------------------------------


def origin_flag_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(text_trajectories(spark, sf_dir)).select(
        "traj_id", "origin_label", "origin_is_negative"
    )


def origin_flag_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("traj_id"),
        F.col("toxic").alias("origin_label"),
        F.lit(1.0).alias("nll_seq"),
    )
    return enrich(rows).select("traj_id", "origin_is_negative")


def lenient_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = LossOptions(require_old_nll=False)
    rows = losses(numeric_trajectories(spark, sf_dir, null_nll=True), options)
    return rounded(rows.select("traj_id", "old_logps", *LOSS))


def advantage_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_trajectories(spark, sf_dir)
    as_text = F.coalesce(F.round("advantage", 3).cast("string"), F.lit("missing"))
    rows = rows.withColumn("advantage", as_text)
    return rounded(
        enrich(rows, LossOptions(default_advantage=0.25)).select("traj_id", "advantage")
    )


def template(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = replay_pairs(table(spark, sf_dir, "conversations"))
        return apply_template(pairs, TokenOptions(template=name)).select("traj_id", *TEXT)

    return query


# --- Replay -------------------------------------------------------------------


def pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_pairs(table(spark, sf_dir, "conversations"))


def group_advantage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_reward(replay_pairs(table(spark, sf_dir, "conversations")))
    return rounded(group_advantage(pairs).select("traj_id", "group_id", "reward", "advantage"))


def event_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("traj_id"), F.col("user_id").alias("group_id"),
        F.col("value").alias("reward"),
    )
    return rounded(group_advantage(rows))


def origin_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_reward(replay_pairs(table(spark, sf_dir, "conversations")))
    label = label_origin(F.col("advantage")).alias("origin_label")
    return group_advantage(pairs).select("traj_id", label)


# --- Tokens -------------------------------------------------------------------


def text_tokens(spark: SparkSession, sf_dir: str, options: TokenOptions = PADDED) -> DataFrame:
    return tokenised(text_trajectories(spark, sf_dir), options=options)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = build_vocabulary(table(spark, sf_dir, "documents"), ["text"])
    return rounded(words)


def encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = store(replay_pairs(table(spark, sf_dir, "conversations")), "pairs")
    words = build_vocabulary(texts, ["response"])
    coded = encode(texts, TEXT, words)
    return coded.select("traj_id", shown(F.col("prompt_ids")).alias("prompt_ids"),
                        shown(F.col("response_ids")).alias("response_ids"))


def encode_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several samples per id, and rows without one: each keeps its own tokens."""
    texts = replay_pairs(table(spark, sf_dir, "conversations"))
    words = build_vocabulary(texts, ["response"])
    group = F.when(F.col("group_id") % 5 != 0, F.col("group_id")).alias("group_id")
    coded = encode(texts.select(group, *TEXT), TEXT, words)
    return coded.select("group_id", shown(F.col("prompt_ids")).alias("prompt_ids"),
                        shown(F.col("response_ids")).alias("response_ids"))


def model_inputs_query(options: TokenOptions) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = text_tokens(spark, sf_dir, options)
        lists = ["input_ids", "attention_mask", "labels"]
        return rows.select("traj_id", *[shown(F.col(c)).alias(c) for c in lists])

    return query


def completion_span_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = completion_span(F.col("labels"), LIMITS.label_pad_token_id)
    rows = text_tokens(spark, sf_dir, LIMITS)
    return rounded(rows.select("traj_id", start.alias("span_start"), end.alias("span_end")))


def truncation_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = truncation_audit(text_tokens(spark, sf_dir, LIMITS), LIMITS)
    return rounded(rows.select("traj_id", "response_tokens", "response_kept", "response_cut"))


def truncation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = truncation_audit(text_tokens(spark, sf_dir, LIMITS), LIMITS)
    lost = F.col("response_tokens") - F.col("response_kept")
    return rows.groupBy("origin_label").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("response_cut").alias("responses_cut"),
        F.sum(lost).alias("tokens_lost"),
    )


# --- Batches ------------------------------------------------------------------


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = replay_pairs(table(spark, sf_dir, "conversations"))
    return assign_batches(pairs, "traj_id", RUN)


def batch_assign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_batches(table(spark, sf_dir, "events"), "event_id", RUN)


def step_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = BatchOptions(per_device=1, accumulation=1, epochs=1, max_steps=5)
    return assign_batches(table(spark, sf_dir, "events"), "event_id", options)


def pad_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = text_trajectories(spark, sf_dir)
    lists = ["input_ids", "attention_mask", "labels"]
    rows = tokenised(base, options=PADDED).select("traj_id", *lists)
    placed = rows.join(assign_batches(base, "traj_id", RUN), "traj_id")
    return pad_batches(placed, PADDED).select(
        "traj_id", *BATCH_KEYS, F.col("batch_max_len").cast("bigint").alias("batch_max_len"),
        *[shown(F.col(c)).alias(c) for c in lists],
    )


def batch_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_text_trajectories(spark, sf_dir)
    return rounded(batch_metrics(losses(rows), assign_batches(rows, "traj_id", RUN)))


def step_metrics_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_text_trajectories(spark, sf_dir)
    per_batch = batch_metrics(losses(rows), assign_batches(rows, "traj_id", RUN))
    return rounded(last_metrics(per_batch, ["epoch", "step_id", "global_step"]))


def step_limit_over_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More steps than one pass has: the step count wins over the one epoch asked for."""
    options = BatchOptions(per_device=4, processes=4, accumulation=8, epochs=1, max_steps=100)
    return assign_batches(table(spark, sf_dir, "events"), "event_id", options)


def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preview(preview_rows(text_tokens(spark, sf_dir), "traj_id"), "preview_key"))


# --- Policies -----------------------------------------------------------------


def trained(
    spark: SparkSession, sf_dir: str, bigram: bool
) -> tuple[DataFrame, TabularPolicy, DataFrame]:
    """Token table, a policy counted on its completions, and the vocabulary."""
    texts = apply_template(text_trajectories(spark, sf_dir), PADDED)
    words = build_vocabulary(texts, TEXT)
    tokens = store(with_model_inputs(encode(texts, TEXT, words), PADDED), "tokens")
    return tokens, fit_policy(tokens, words.count(), bigram, SMOOTHING, options=PADDED), words


def unigram_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trained(spark, sf_dir, False)[1].counts)


def bigram_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trained(spark, sf_dir, True)[1].counts)


def weighted_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenised(text_trajectories(spark, sf_dir), options=PADDED)
    policy = fit_policy(tokens, 1, weight="reward", options=PADDED)
    return rounded(policy.counts.where(F.col("n") > 0))


def score_query(bigram: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens, policy, words = trained(spark, sf_dir, bigram)
        return rounded(sequence_scores(score_tokens(tokens, policy, options=PADDED)))

    return query


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, policy, words = trained(spark, sf_dir, True)
    scores = score_tokens(tokens, policy, options=PADDED).where(F.col("pos").isNotNull())
    return rounded(scores)


def sequence_nll_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, policy, words = trained(spark, sf_dir, False)
    return rounded(sequence_nll(score_tokens(tokens, policy, options=PADDED)))


def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to metrics: the behaviour policy is the unigram, the policy the bigram."""
    tokens, policy, words = trained(spark, sf_dir, True)
    behaviour = fit_policy(tokens, policy.vocab_size, False, SMOOTHING, options=PADDED)
    nll = sequence_nll(score_tokens(tokens, behaviour, options=PADDED))
    scores = sequence_scores(score_tokens(tokens, policy, options=PADDED))
    rows = tokens.drop("nll_seq").join(nll, "traj_id")
    return rounded(metrics(scored_losses(rows, scores), ["origin_is_negative"]))


def policy_update_query(options: LossOptions) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens, policy, words = trained(spark, sf_dir, False)
        samples = enrich(tokens, options)
        return rounded(
            policy_update(samples, unigram_logits(policy, words), 0.1, options, options=PADDED)
        )

    return query


def policy_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, policy, words = trained(spark, sf_dir, False)
    theta = train_policy(enrich(tokens), unigram_logits(policy, words), 0.1, 2, options=PADDED)
    return rounded(theta)


def softmax_of_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The softmax policy that training starts from gives the fitted policy's probabilities."""
    _, policy, words = trained(spark, sf_dir, False)
    return rounded(softmax_policy(unigram_logits(policy, words)))


def logits_softmax_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    score = log_softmax_at(F.col("embedding"), F.col("label")).alias("token_logp")
    return rounded(rows.select("vec_id", score))


def logits_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 8 positions of 8 logits, of which the last 6 are labelled."""
    rows = table(spark, sf_dir, "embeddings")
    logits = rows.select(
        F.col("vec_id").alias("traj_id"), F.posexplode("embedding").alias("cell", "logit")
    ).select(
        "traj_id", F.floor(F.col("cell") / 8).cast("int").alias("pos"),
        (F.col("cell") % 8).alias("token"), F.col("logit").cast("double").alias("logit"),
        F.lit(2).alias("skipped"),
    )
    targets = rows.select(
        F.col("vec_id").alias("traj_id"), "label",
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos"),
    ).select("traj_id", "pos", ((F.col("label") + F.col("pos")) % 8).alias("token"))
    return rounded(logits_scores(logits, targets, "skipped"))


def logits_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms side by side where a third of the logits is masked, some targets among them."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") % 8).cast("int").alias("label"),
        F.transform(F.slice("embedding", 1, 8), lambda x, i: F.when((F.col("vec_id") + i) % 3 == 0, float("-inf")).otherwise(x.cast("double"))).alias("logits"),
    )
    cells = rows.select(F.col("vec_id").alias("traj_id"), F.lit(0).alias("pos"), F.posexplode("logits").alias("token", "logit"))
    targets = rows.select(F.col("vec_id").alias("traj_id"), F.lit(1).alias("pos"), F.col("label").alias("token"))
    # An infinite number as text, which all engines show alike.
    shown = lambda c: F.when(c == float("-inf"), "masked").otherwise(F.format_string("%.4f", c))
    long = logits_scores(cells, targets).select(F.col("traj_id").alias("vec_id"), shown(F.col("token_logp")).alias("long_form"))
    return rows.select("vec_id", shown(log_softmax_at(F.col("logits"), F.col("label"))).alias("array_form")).join(long, "vec_id")


# --- User functions -----------------------------------------------------------


def code_points(text: str) -> list[int]:
    return [ord(character) for character in text]


def make_code_points() -> Callable[[str], list[int]]:
    return code_points


def encode_user_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that no double holds, beside nulls, pass a user's encoder unchanged."""
    rows = table(spark, sf_dir, "benchmark")
    great = F.when(F.col("item_id") % 3 > 0, F.col("item_id") + F.lit(2**53 + 1))
    coded = encode_with(rows.select("item_id", great.alias("great"), "text"), lambda: code_points, ["text"])
    return coded.select("item_id", "great", F.size("text_ids").cast("long").alias("n"), F.aggregate("text_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def user_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's tokenizer: here one token per character, its code point."""
    pairs = replay_pairs(table(spark, sf_dir, "conversations"))
    coded = with_model_inputs(encode_with(pairs, make_code_points, TEXT), LIMITS)
    return coded.select("traj_id", shown(F.col("input_ids")).alias("input_ids"),
                        shown(F.col("labels")).alias("labels"))


def count_letters(row: dict, letters: str) -> dict:
    return {"letters": sum(character in letters for character in row["text"])}


def user_row_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("letters", T.LongType())])
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return map_rows(rows, count_letters, schema, {"letters": "aeiou"}, ["text"])


def batch_drift(rows: list[dict]) -> list[dict]:
    """Values weighted by their place in the batch: another order, another result."""
    place = {name: rows[0][name] for name in ("epoch", "batch_id")}
    drift = sum(i * row["value"] for i, row in enumerate(rows, 1))
    return [{**place, "rows": len(rows), "drift": drift, "first_id": rows[0]["event_id"]}]


DRIFT = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("drift", T.DoubleType()),
        T.StructField("first_id", T.LongType()),
    ]
)


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return events.join(assign_batches(events, "event_id", RUN), "event_id")


def user_batch_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(map_batches(placed_events(spark, sf_dir), batch_drift, DRIFT, ["epoch", "batch_id"]), 4)


def udtf_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function of ordered batches, called from SQL."""
    register_batch_function(spark, "batch_drift", batch_drift, DRIFT)
    call = "SELECT * FROM batch_drift(TABLE(SELECT * FROM {placed}) PARTITION BY (epoch, batch_id) ORDER BY position)"
    return rounded(spark.sql(call, placed=placed_events(spark, sf_dir)), 4)


def toy_logits(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """16 logits per position from the ids of its row up to it."""
    seen = np.cumsum(ids * mask, axis=1)[:, :, None]
    return ((seen + 3 * np.arange(16)) % 7) / 2.0


def make_toy_model():
    return toy_logits


def user_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's causal model, over token ids folded into 16 classes."""
    rows = text_tokens(spark, sf_dir, LIMITS)
    folded = F.transform("labels", lambda label: F.when(label < 0, label).otherwise(label % 16))
    scores = score_with(rows.withColumn("labels", folded), make_toy_model, options=LIMITS)
    return rounded(scores.where(F.col("pos").isNotNull()))


# --- Sources, sinks, streams --------------------------------------------------


def source_columns(df: DataFrame) -> DataFrame:
    return rounded(prune(df, ["traj_id"]))


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two JSON files of the trajectories, read back as one list."""
    rows = text_trajectories(spark, sf_dir)
    paths = [new_path(spark, "negative") + ".jsonl", new_path(spark, "other") + ".json"]
    is_negative = F.coalesce(F.col("advantage") < 0, F.lit(False))
    rows.where(is_negative).write.json(paths[0])
    rows.where(~is_negative).write.json(paths[1])
    return source_columns(read_trajectories(spark, "||".join(paths), rows.schema)["train"])


def late_columns(rows: DataFrame) -> list[DataFrame]:
    """The rows in two parts, of which only the second has labels and advantages."""
    plain = F.col("origin_label").isNull() & F.col("advantage").isNull()
    return [rows.where(plain).drop("origin_label", "advantage"), rows.where(~plain)]


def json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No schema given; labels and advantages come in the second file only."""
    paths = [new_path(spark, "early") + ".jsonl", new_path(spark, "late") + ".jsonl"]
    for part, path in zip(late_columns(text_trajectories(spark, sf_dir)), paths):
        part.write.json(path)
    rows = read_trajectories(spark, "||".join(paths))["train"]
    return rounded(enrich(rows).select("traj_id", "old_logps", "advantage", "origin_is_negative"))


def json_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids beyond the whole numbers that a double holds stay as they are."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") + F.lit((1 << 53) + 1)).alias("traj_id"), F.lit("p").alias("prompt"),
        F.lit("r").alias("response"), F.floor("value").alias("nll_seq"),
    )
    path = new_path(spark, "ids") + ".jsonl"
    rows.write.json(path)
    back = read_trajectories(spark, path)["train"]
    return rounded(back.select("traj_id", "nll_seq"))


def parquet_mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder whose files have different columns."""
    path = new_path(spark, "mixed")
    for part in late_columns(text_trajectories(spark, sf_dir)):
        part.write.mode("append").parquet(path)
    rows = read_trajectories(spark, path)["train"]
    return rounded(enrich(rows).select("traj_id", "old_logps", "advantage", "origin_is_negative"))


def directory_with_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON data beside a card and an info file, none of them named after a split."""
    path = new_path(spark, "carded")
    text_trajectories(spark, sf_dir).write.json(f"{path}/data")
    card = spark.range(1).select(F.lit('{"description": "no row"}').alias("value"))
    names = {"info.json": f"{path}/.card", "README.md": f"{path}/.readme"}
    for name, part in names.items():
        card.coalesce(1).write.text(part)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        (written,) = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
        files.rename(written, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    return source_columns(read_trajectories(spark, path)["train"])


def replay_pairs_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers that are times, a minute apart."""
    turns = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn") * 60_000)
    return replay_pairs(turns)


def parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parquet files with different columns, read back as one list."""
    rows = text_trajectories(spark, sf_dir)
    paths = [new_path(spark, "flagged") + ".parquet", new_path(spark, "plain") + ".parquet"]
    has_label = F.col("origin_label").isNotNull()
    rows.where(has_label).write.parquet(paths[0])
    rows.where(~has_label).drop("origin_label").write.parquet(paths[1])
    return source_columns(read_trajectories(spark, "||".join(paths))["train"])


def split_folder(spark: SparkSession, sf_dir: str) -> str:
    """A dataset directory; trajectories without an advantage are its test split."""
    rows = text_trajectories(spark, sf_dir)
    path = new_path(spark, "dataset")
    split = F.when(F.col("advantage").isNull(), "test").otherwise("train")
    rows.withColumn("split", split).write.partitionBy("split").parquet(path)
    return path


def split_dataset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return read_trajectories(spark, split_folder(spark, sf_dir))


def source_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test split through the named source, which opens its files alone."""
    register_source(spark)
    rows = spark.read.format("trajectories").option("split", "test").load(split_folder(spark, sf_dir))
    return rounded(prune(rows, ["traj_id", "split"]))


def directory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = split_dataset(spark, sf_dir)
    return source_columns(splits["train"])


def split_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = split_dataset(spark, sf_dir)
    tagged = [df.select(F.lit(name).alias("split")) for name, df in splits.items()]
    return split_counts(tagged[0].unionByName(tagged[1]))


def missing_label_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "unlabelled") + ".parquet"
    text_trajectories(spark, sf_dir).drop("origin_label").write.parquet(path)
    rows = read_trajectories(spark, path)["train"]
    return rounded(enrich(rows).select("traj_id", "origin_label", "origin_is_negative"))


def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses(numeric_trajectories(spark, sf_dir))
    path = new_path(spark, "metrics")
    negative = F.col("origin_label") == "negative"
    results = {"train": rounded(metrics(rows.where(~negative))), "eval": rounded(metrics(rows.where(negative)))}
    for split, result in [*results.items(), ("eval", results["eval"])]:
        save_metrics(result, path, split)  # the second record of a split takes the place of the first
    schema = T.StructType([T.StructField("split", T.StringType()), *results["train"].schema.fields])
    return spark.read.schema(schema).json(path)


def training_set_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = text_trajectories(spark, sf_dir)
    ready = model_batch(enrich(tokenised(base, options=PADDED)), ["traj_id"])
    path = new_path(spark, "training-set")
    assignment = assign_batches(base, "traj_id", RUN)
    save_training_set(training_set(ready, assignment, "traj_id", PADDED, 4), path)
    back = spark.read.parquet(path)
    return rounded(
        back.select(
            "traj_id", "epoch", "batch_id", "rank", "old_logps", "advantage", "origin_is_negative",
            shown(F.col("input_ids")).alias("input_ids"), shown(F.col("labels")).alias("labels"),
        )
    )


def scoreboard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for answers: language and source for benchmark and model."""
    graded = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id"
    )
    graded = graded.select(
        F.col("lang").alias("benchmark"), F.col("source").alias("model"),
        (F.col("quality") == 1).alias("correct"),
    )
    return rounded(scoreboard(graded, ["benchmark", "model"]))


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return enriched_losses(event_trajectories(read_feed(spark, sf_dir, schema, "events.parquet")))


def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_feed(spark, sf_dir).select("traj_id", "old_logps", *LOSS, "capped")
    return rounded(drain(rows, "stream-losses"))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    rows = drain(windowed_metrics(event_feed(spark, sf_dir)), "stream-metrics")
    edges = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(rows.withColumns(edges))


def stream_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns a minute apart, the even ones first, then a row that closes all conversations."""
    feed, out, progress = new_paths(spark, "stream-pairs")
    turns = table(spark, sf_dir, "conversations")
    turns = turns.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60))
    close = turns.limit(1).select(*[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in turns.columns[:-1]], F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"))
    for part in (turns.where("turn % 2 = 0"), turns.where("turn % 2 = 1"), close):
        part.write.mode("append").parquet(feed)
        rows = drain(stream_pairs(read_feed(spark, feed, turns.schema), "ts", "3650 days", 60), "stream-pairs", out, progress)
    return rows


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the events, then the last fifth, much of it late, and some once more."""
    feed, out, progress = new_paths(spark, "stream-late")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in (events.where("event_id % 5 <> 0"), events.where("event_id % 5 <= 1")):
        part.write.mode("append").parquet(feed)
        rows = drain_with_fates(read_feed(spark, feed, events.schema), ["event_id"], "ts", 5 * 86400, out, progress)
    return rows.select("event_id", "batch", "fate")


QUERIES: dict[str, Query] = {
    "sample_loss": sample_loss(LossOptions()),
    "sample_loss_length_norm": sample_loss(LossOptions(length_normalize=True)),
    "sample_loss_alpha5": sample_loss(LossOptions(alpha=5.0)),
    "sample_loss_default_adv": sample_loss(
        LossOptions(use_dataset_advantage=False, default_advantage=2.0)
    ),
    "global_metrics": global_metrics,
    "global_metrics_length_norm": global_metrics_length_norm,
    "metrics_by_label": metrics_by_label,
    "metrics_of_text": metrics_of_text,
    "metrics_rollup": rollup,
    "distinct_rollup": distinct_prompts,
    "delta_metrics": delta_metrics,
    "eval_metrics": eval_metrics,
    "expert_mix": expert_mix,
    "mixed_by_ratio": mixed_by_ratio,
    "asof_policy": asof_policy,
    "interval_steps": interval_steps,
    "session_trajectories": session_trajectories,
    "origin_flag_string": origin_flag_string,
    "origin_flag_numeric": origin_flag_numeric,
    "lenient_nll": lenient_nll,
    "advantage_default": advantage_default,
    "template_alpaca": template("alpaca"),
    "template_math": template("deepseek-math"),
    "template_boxed": template("qwen2-boxed"),
    "template_default": template("ours"),
    "replay_pairs": pairs_query,
    "replay_pairs_sparse": replay_pairs_sparse,
    "group_advantage": group_advantage_query,
    "event_advantage": event_advantage,
    "origin_labelling": origin_labelling,
    "vocabulary": vocabulary,
    "encode": encode_query,
    "encode_repeated_ids": encode_repeated_ids,
    "truncate_keep_end": model_inputs_query(LIMITS),
    "truncate_keep_start": model_inputs_query(KEEP_START),
    "labels_mask": model_inputs_query(TokenOptions()),
    "completion_span": completion_span_query,
    "truncation_audit": truncation_audit_query,
    "truncation_counts": truncation_counts,
    "batch_assign": batch_assign,
    "batch_assign_events": batch_assign_events,
    "step_limit": step_limit,
    "step_limit_over_epochs": step_limit_over_epochs,
    "pad_batches": pad_batches_query,
    "batch_metrics": batch_metrics_query,
    "step_metrics_last": step_metrics_last,
    "preview": preview_query,
    "unigram_policy": unigram_policy,
    "bigram_policy": bigram_policy,
    "weighted_policy": weighted_policy,
    "score_unigram": score_query(False),
    "score_bigram": score_query(True),
    "token_scores": token_scores,
    "sequence_nll": sequence_nll_query,
    "policy_metrics": policy_metrics,
    "policy_update": policy_update_query(LossOptions()),
    "policy_update_length_norm": policy_update_query(LossOptions(length_normalize=True)),
    "policy_training": policy_training,
    "softmax_of_unigram": softmax_of_unigram,
    "logits_softmax_gather": logits_softmax_gather,
    "logits_long": logits_long,
    "logits_masked": logits_masked,
    "user_encoder": user_encoder,
    "encode_user_long_ids": encode_user_long_ids,
    "user_row_map": user_row_map,
    "user_batch_function": user_batch_function,
    "udtf_batches": udtf_batches,
    "user_scorer": user_scorer,
    "json_source": json_source,
    "json_inferred": json_inferred,
    "json_long_ids": json_long_ids,
    "parquet_mixed_folder": parquet_mixed_folder,
    "directory_with_card": directory_with_card,
    "parquet_source": parquet_source,
    "directory_source": directory_source,
    "source_by_name": source_by_name,
    "split_counts": split_counts_query,
    "missing_label_source": missing_label_source,
    "metrics_sink": metrics_sink,
    "training_set_sink": training_set_sink,
    "scoreboard": scoreboard_query,
    "stream_enrich": stream_enrich,
    "stream_metrics": stream_metrics,
    "stream_pairs": stream_pairs_query,
    "stream_late_rows": stream_late_rows,
}
