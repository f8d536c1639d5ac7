"""Tabular policies over token ids: fitting, scoring and the policy-gradient step.

They stand where a neural model would: any job that yields one log-prob per
completion token can replace them (see ``operators.userfn`` for user models).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajloom.functions.tokens import scored_tokens
from trajloom.operators.enrich import with_loss
from trajloom.operators.lookup import BROADCAST_BYTES, HOT_ROWS, fits_broadcast, lookup_join
from trajloom.operators.store import store
from trajloom.options import LossOptions, TokenOptions


@dataclass(frozen=True)
class TabularPolicy:
    """Smoothed counts.

    ``counts`` holds (token, n), or (prev, token, n) for a bigram policy; ``contexts``
    holds (prev, total) of a bigram policy; ``total`` is the mass of a unigram policy.
    """

    counts: DataFrame
    contexts: DataFrame | None
    total: float
    vocab_size: int
    smoothing: float

    @property
    def is_bigram(self) -> bool:
        return self.contexts is not None


def completion_tokens(
    df: DataFrame, carry: list[str], options: TokenOptions = TokenOptions(), outer: bool = False
) -> DataFrame:
    """(carry…, pos, prev, token) per scored token; ``outer`` keeps empty completions."""
    items = scored_tokens(F.col("input_ids"), F.col("labels"), options.label_pad_token_id)
    explode = F.inline_outer if outer else F.inline
    return df.select(*carry, explode(items))


def fit_policy(
    df: DataFrame,
    vocab_size: int,
    bigram: bool = False,
    smoothing: float = 1.0,
    weight: str | None = None,
    options: TokenOptions = TokenOptions(),
) -> TabularPolicy:
    """Count the completion tokens, each by its row's ``weight`` if given.

    Counting combines on the map side, so frequent tokens cost no more than rare ones.
    """
    tokens = completion_tokens(df, [weight] if weight else [], options)
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    keys = ["prev", "token"] if bigram else ["token"]
    counts = store(tokens.groupBy(*keys).agg(F.sum(mass).alias("n")), "policy")
    contexts, total = None, 0.0
    if bigram:
        contexts = store(counts.groupBy("prev").agg(F.sum("n").alias("total")), "contexts")
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0.0
    return TabularPolicy(counts, contexts, total, vocab_size, smoothing)


def _log_share(part: Column, whole: Column) -> Column:
    """ln(part / whole), -inf for a share of 0 (Spark's ln(0) is NULL)."""
    return F.when(part > 0, F.ln(part) - F.ln(whole)).otherwise(F.lit(-math.inf))


def score_tokens(
    df: DataFrame,
    policy: TabularPolicy,
    id_col: str = "traj_id",
    options: TokenOptions = TokenOptions(),
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, pos, token, token_logp) per completion token.

    A trajectory without scored tokens keeps one row with nulls, so that sums per
    trajectory lose nobody. Ids must be unique; ``training_run.with_ids`` makes such ids.
    """
    small = fits_broadcast(policy.counts, broadcast_bytes)
    if policy.is_bigram:
        small_contexts = fits_broadcast(policy.contexts, broadcast_bytes)
    else:
        small_contexts = True
    rows = df.select(id_col, "input_ids", "labels")
    if small and small_contexts:
        rows = rows.repartition(id_col)
    tokens = completion_tokens(rows, [id_col], options, outer=True)
    keys = ["prev", "token"] if policy.is_bigram else ["token"]
    spread = [id_col, "pos"]
    found = lookup_join(tokens, policy.counts, keys, spread, small, hot_rows)
    k, v = float(policy.smoothing), float(policy.vocab_size)
    seen = F.coalesce(F.col("n"), F.lit(0.0)) + k
    if policy.is_bigram:
        found = lookup_join(
            found, policy.contexts, ["prev"], spread, small_contexts, hot_rows, counted=tokens
        )
        whole = F.coalesce(F.col("total"), F.lit(0.0)) + k * v
    else:
        whole = F.lit(policy.total + k * v)
    logp = F.when(F.col("token").isNotNull(), _log_share(seen, whole))
    return found.select(id_col, "pos", "token", logp.alias("token_logp"))


def sequence_scores(token_scores: DataFrame, id_col: str = "traj_id") -> DataFrame:
    """``policy_logps`` and ``completion_len`` (at least 1) per trajectory."""
    scored = F.count("token_logp")
    return token_scores.groupBy(id_col).agg(
        F.coalesce(F.sum("token_logp"), F.lit(0.0)).alias("policy_logps"),
        F.greatest(scored, F.lit(1)).cast("double").alias("completion_len"),
        scored.alias("scored_tokens"),
    )


def sequence_nll(token_scores: DataFrame, id_col: str = "traj_id") -> DataFrame:
    """The NLL of each response under the policy that scored it."""
    total = F.coalesce(F.sum("token_logp"), F.lit(0.0))
    return token_scores.groupBy(id_col).agg((F.lit(0.0) - total).alias("nll_seq"))


# Logits of one class lie within SPAN, so their exponentials, taken from its lower end, stay finite.
SPAN = 500.0


def logits_scores(
    logits: DataFrame,
    targets: DataFrame,
    shift: str | None = None,
    id_col: str = "traj_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Token log-probs from a long table (id, pos, token, logit) of raw logits.

    ``targets`` holds (id, pos, token) of the scored tokens; the logits at ``pos - 1``
    predict the token at ``pos``. ``shift`` names a column of ``logits`` with the number
    of logit positions in front of the labelled ones, to be skipped. The log-sum-exp is
    summed per class of logits of similar size, so it combines before the shuffle; the
    logits themselves are moved only if the targets are too many to broadcast. A logit of
    -inf is a masked token: it adds nothing to the sum, and as a target it has log-prob -inf.
    Where all logits of a position are masked, or one is +inf or NaN, the result is NaN, as in
    floating-point arithmetic. A target without a logit is an error; null logits are none.
    """
    at = F.col("pos") + 1
    if shift is not None:
        at = at - F.col(shift)
    scores = logits.select(id_col, at.alias("pos"), F.col("token"), F.col("logit").cast("double").alias("logit"))
    targets = targets.select(id_col, "pos", "token")
    scores = scores.where(F.col("logit").isNotNull())
    # Masked logits lie in the lowest class, where their share is 0; NaN and +inf spoil their sum.
    masked = F.col("logit") == float("-inf")
    finite = ~masked & ~F.isnan("logit") & (F.col("logit") != float("inf"))
    sized = scores.withColumn("_class", F.when(finite, F.floor(F.col("logit") / SPAN).cast("double")))
    share = F.when(masked, 0.0).when(finite, F.exp(F.col("logit") - F.col("_class") * SPAN)).otherwise(float("nan"))
    parts = sized.groupBy(id_col, "pos", "_class").agg(F.sum(share).alias("_sum"))
    # Of the class without a number only its spoiling matters: 0 if all of it is masked.
    spoilt = F.when(F.isnan("_sum"), float("nan"))
    part = F.struct(F.col("_class").alias("c"), F.when(F.col("_class").isNotNull(), F.ln("_sum")).otherwise(spoilt).alias("s"))
    norms = parts.groupBy(id_col, "pos").agg(F.collect_list(part).alias("_parts"), F.max("_class").alias("_top"))
    # A few classes per position.
    own = lambda p: F.when(p["s"].isNull(), 0.0).when(p["c"].isNull(), p["s"]).otherwise(F.exp(p["s"] + (p["c"] - F.col("_top")) * SPAN))
    shares = F.aggregate("_parts", F.lit(0.0), lambda total, p: total + own(p))
    # Without a finite logit there is no class, and no probability.
    norm = F.when(F.col("_top").isNotNull(), F.ln(shares) + F.col("_top") * SPAN).otherwise(float("nan"))
    norms = norms.select(id_col, "pos", norm.alias("_norm"))
    keys = [id_col, "pos", "token"]
    small = F.broadcast(targets.distinct()) if fits_broadcast(targets, broadcast_bytes) else targets.distinct()
    picked = scores.join(small, keys).select(*keys, "logit")
    rows = targets.join(norms, [id_col, "pos"], "left").join(picked, keys, "left")
    error = F.raise_error(F.lit("a target has no logit")).cast("boolean")
    known = F.col("logit").isNotNull() & F.col("_norm").isNotNull()
    rows = rows.where(F.when(known, F.lit(True)).otherwise(error))
    return rows.select(id_col, "pos", "token", (F.col("logit") - F.col("_norm")).alias("token_logp"))


def unigram_logits(policy: TabularPolicy, vocabulary: DataFrame) -> DataFrame:
    """(token, theta) of the softmax policy that equals a smoothed unigram policy.

    ``vocabulary`` holds every ``token_id`` that the policy's vocabulary size counts; tokens
    that were never seen get the logit of the smoothing alone.
    """
    if not policy.smoothing > 0:
        raise ValueError("a token with probability 0 has no logit: smoothing must be positive")
    tokens = vocabulary.select(F.col("token_id").alias("token")).distinct()
    counts = tokens.join(policy.counts, "token", "full")
    return counts.select("token", F.ln(F.coalesce("n", F.lit(0.0)) + policy.smoothing).alias("theta"))


def softmax_policy(theta: DataFrame) -> DataFrame:
    """(token, theta, logp) of the softmax over all tokens of the table."""
    top = theta.agg(F.max("theta")).first()[0]
    if top is None:
        raise ValueError("the policy table is empty")
    total = theta.agg(F.sum(F.exp(F.col("theta") - top))).first()[0]
    return theta.withColumn("logp", F.col("theta") - F.lit(top + math.log(total)))


def counted_samples(samples: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """The samples as the gradient needs them, written: a row number of their own, the columns
    of the loss, and the completion's distinct tokens with their numbers."""
    rows = samples.withColumn("_row", F.monotonically_increasing_id())
    tokens = F.transform(scored_tokens(F.col("input_ids"), F.col("labels"), options.label_pad_token_id), lambda t: t["token"])
    kept = [c for c in ("old_logps", "advantage", "origin_is_negative") if c in samples.columns]
    rows = rows.select("_row", *kept, F.array_sort(tokens).alias("_all"))
    # Equal tokens lie side by side: a run's length is where the next one begins.
    starts = F.filter(
        F.transform("_all", lambda t, i: F.when((i == 0) | (t != F.get("_all", i - 1)), i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumn("_starts", starts)
    counts = F.transform(
        "_starts",
        lambda at, k: F.struct(
            F.get("_all", at).alias("token"),
            (F.coalesce(F.get("_starts", k + 1), F.size("_all")) - at).alias("n"),
        ),
    )
    return store(rows.withColumn("tokens", counts).drop("_all", "_starts"), "samples")


def logp_sums(table: pa.Table) -> Callable[[Column, Column], Column]:
    """The sum of n times the log-prob of each list of tokens and of their numbers n."""
    known, logps = table["token"].combine_chunks(), table["token_logp"].to_numpy()

    @F.arrow_udf("double")
    def sums(tokens: pa.Array, numbers: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        at = pc.index_in(flat, known)
        if at.null_count:
            raise ValueError(f"no logit for token {flat.filter(pc.is_null(at))[0]}")
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        parts = logps[at.to_numpy()] * numbers.flatten().to_numpy()
        owners = np.repeat(np.arange(len(sizes)), sizes)
        return pa.array(np.bincount(owners, weights=parts, minlength=len(sizes)), pa.float64())

    return sums


def _summed_in_place(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``policy_logps`` and ``_scored`` to the counted samples, without a shuffle."""
    sums = logp_sums(table.select(F.col("token").cast("long").alias("token"), "token_logp").toArrow())
    tokens = F.transform("tokens", lambda t: t["token"].cast("long"))
    numbers = F.transform("tokens", lambda t: t["n"].cast("long"))
    whole = F.aggregate("tokens", F.lit(0).cast("long"), lambda total, t: total + t["n"])
    return rows.withColumns({"policy_logps": sums(tokens, numbers), "_scored": F.coalesce(whole, F.lit(0))})


def _summed_by_join(rows: DataFrame, table: DataFrame, hot_rows: int) -> DataFrame:
    tokens = rows.select("_row", F.inline("tokens"))
    found = lookup_join(tokens, table, ["token"], ["_row"], False, hot_rows)
    error = F.raise_error(F.concat(F.lit("no logit for token "), F.col("token").cast("string"))).cast("boolean")
    found = found.where(F.when(F.col("token_logp").isNotNull(), F.lit(True)).otherwise(error))
    sums = found.groupBy("_row").agg(F.sum(F.col("n") * F.col("token_logp")).alias("_sum"), F.sum("n").alias("_scored"))
    return rows.join(sums, "_row", "left").withColumns(
        {"policy_logps": F.coalesce("_sum", F.lit(0.0)), "_scored": F.coalesce("_scored", F.lit(0))}
    )


def policy_update(
    samples: DataFrame,
    theta: DataFrame,
    lr: float,
    loss_options: LossOptions = LossOptions(),
    options: TokenOptions = TokenOptions(),
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One gradient step on the mean loss for a unigram softmax policy.

    With A(v) the summed coefficients of all occurrences of token v and S their sum
    over all tokens, the gradient is (A(v) - S * pi(v)) / rows. The ratio inside the
    coefficient counts as a constant. ``samples`` has the token lists and the enriched
    columns, or comes from :func:`counted_samples`; a token that is not in ``theta`` is an
    error. A ``theta`` whose measured size is within the limit goes to all tasks, and a row is
    summed where it lies; a larger one is joined to the tokens.
    Returns (token, theta, gradient, new_theta).
    """
    rows = samples if "tokens" in samples.columns else counted_samples(samples, options)
    policy = store(softmax_policy(theta), "softmax")
    small = fits_broadcast(policy, broadcast_bytes)
    table = policy.select("token", F.col("logp").alias("token_logp"))
    if small:
        scored = _summed_in_place(rows, table)
    else:
        scored = _summed_by_join(rows, table, hot_rows)
    scored = scored.withColumn("completion_len", F.greatest("_scored", F.lit(1)).cast("double"))
    losses = with_loss(scored, loss_options)
    coef = F.col("coef") / F.col("completion_len") if loss_options.length_normalize else F.col("coef")
    weighted = store(losses.select(coef.alias("_coef"), "_scored", "tokens"), "coefficients")
    count, whole = weighted.agg(F.count(F.lit(1)), F.sum(F.col("_coef") * F.col("_scored"))).first()
    used = weighted.select("_coef", F.inline("tokens"))
    masses = used.groupBy("token").agg(F.sum(F.col("_coef") * F.col("n")).alias("_a"))
    gradient = (F.coalesce("_a", F.lit(0.0)) - F.exp("logp") * F.lit(whole or 0.0)) / F.lit(max(count, 1))
    return (
        policy.join(masses, "token", "left")
        .withColumn("gradient", gradient)
        .select("token", "theta", "gradient", (F.col("theta") - lr * F.col("gradient")).alias("new_theta"))
    )


def train_policy(
    samples: DataFrame,
    theta: DataFrame,
    lr: float,
    steps: int,
    loss_options: LossOptions = LossOptions(),
    options: TokenOptions = TokenOptions(),
) -> DataFrame:
    """Several full-batch steps. Each step's table is written, so the plan stays short."""
    rows = counted_samples(samples, options)
    for _ in range(steps):
        updated = policy_update(rows, theta, lr, loss_options, options)
        theta = store(updated.select("token", F.col("new_theta").alias("theta")), "theta")
    return theta
