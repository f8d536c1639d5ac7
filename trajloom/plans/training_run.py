"""The job from a trajectory file to a training set, scores and metrics."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.operators.batching import assign_batches, training_set
from trajloom.operators.enrich import apply_template, enrich, model_batch, preview, with_loss
from trajloom.operators.indexing import order_key, range_positions
from trajloom.operators.metrics import metrics
from trajloom.operators.policy import TabularPolicy, score_tokens, sequence_scores
from trajloom.operators.store import store
from trajloom.operators.tokenise import build_vocabulary, encode, with_model_inputs
from trajloom.operators.userfn import encode_with
from trajloom.options import BatchOptions, LossOptions, TokenOptions
from trajloom.sources.reader import TEST, TRAIN, check_tokenised, prune, read_trajectories
from trajloom.sources.writer import save_metrics, save_training_set

logger = logging.getLogger(__name__)
TEXTS = ["prompt", "response"]


ROW_ID = "row_id"


def with_ids(df: DataFrame, id_col: str = ROW_ID) -> DataFrame:
    """The rows, written, with a dense number each that hangs on their content alone.

    Rows are numbered in the order of a checksum of all columns; equal rows, which are
    interchangeable, are told apart by place. Files, partitions and settings play no part.
    """
    named = df.drop(id_col)
    key = F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    rows = named.withColumns({"_key": key, "_tie": F.monotonically_increasing_id()})
    numbered = range_positions(rows, [F.asc("_key"), F.asc("_tie")])
    return numbered.withColumnRenamed("position", id_col).drop("_key", "_tie")


def tokenised(
    df: DataFrame,
    vocabulary: DataFrame | None = None,
    options: TokenOptions = TokenOptions(),
    make_encoder: Callable[[], Callable[[str], list[int]]] | None = None,
) -> DataFrame:
    """Template, encode, truncate and mask; side columns stay for the loss.

    ``make_encoder`` makes a user's own tokenizer; without one the words of ``vocabulary``
    are the tokens, or of a vocabulary built here.
    """
    texts = apply_template(df, options)
    if make_encoder is not None:
        coded = encode_with(texts, make_encoder, TEXTS)
    else:
        words = build_vocabulary(texts, TEXTS) if vocabulary is None else vocabulary
        coded = encode(texts, TEXTS, words)
    rows = with_model_inputs(coded, options)
    check_tokenised(rows)
    return rows


def scored_losses(
    tokens: DataFrame,
    scores: DataFrame,
    options: LossOptions = LossOptions(),
    id_col: str = "traj_id",
) -> DataFrame:
    """Enriched rows with their scores and losses. Only narrow columns are joined."""
    side = [c for c in ("nll_seq", "advantage", "origin_label") if c in tokens.columns]
    rows = enrich(tokens.select(id_col, *side), options)
    return with_loss(rows.join(scores, id_col), options)


def batch_metrics(
    losses: DataFrame,
    assignment: DataFrame,
    options: LossOptions = LossOptions(),
    id_col: str = "traj_id",
) -> DataFrame:
    """One metric row per forward call and device."""
    keys = ["epoch", "global_step", "step_id", "batch_id", "rank"]
    return metrics(losses.join(assignment.select(id_col, *keys), id_col), keys, options)


def prepare_training_set(
    spark: SparkSession,
    data_path: str,
    output_dir: str,
    token_options: TokenOptions = TokenOptions(),
    loss_options: LossOptions = LossOptions(),
    batch_options: BatchOptions = BatchOptions(),
    schema: T.StructType | None = None,
    make_encoder: Callable[[], Callable[[str], list[int]]] | None = None,
) -> dict[str, DataFrame]:
    """Read, check, tokenise, batch and pad; write the training set. Returns token tables.

    Rows get an id of their own, ``row_id``; ids in the data are data. The token tables lie
    in the shared folder until ``store.remove_stored`` is called.
    """
    splits = read_trajectories(spark, data_path, schema)
    rows = {name: with_ids(prune(df, ["traj_id"])) for name, df in splits.items()}
    vocabulary = None
    if make_encoder is None:
        vocabulary = build_vocabulary(apply_template(rows[TRAIN], token_options), TEXTS)
    tables = {
        name: store(tokenised(df, vocabulary, token_options, make_encoder), name)
        for name, df in rows.items()
    }
    for row in preview(preview_rows(tables[TRAIN], ROW_ID, batch_options.seed), "preview_key").collect():
        logger.info("sample %s", row.asDict())
    known = [c for c in ("traj_id",) if c in tables[TRAIN].columns]
    ready = model_batch(enrich(tables[TRAIN], loss_options), [ROW_ID, *known])
    assignment = assign_batches(tables[TRAIN], ROW_ID, batch_options)
    save_training_set(training_set(ready, assignment, ROW_ID, token_options), output_dir)
    return tables


def evaluate(
    tables: dict[str, DataFrame],
    policy: TabularPolicy,
    metrics_dir: str,
    token_options: TokenOptions = TokenOptions(),
    loss_options: LossOptions = LossOptions(),
    id_col: str = ROW_ID,
    run: str | None = None,
) -> None:
    """Score each table under a policy and save its metrics, in place of an earlier evaluation's.

    The split ``test`` is named ``eval``; further evaluation sets keep their names, as in
    ``eval_math``. Each ``run`` has records of its own.
    """
    for name, df in tables.items():
        scores = sequence_scores(score_tokens(df, policy, id_col, token_options), id_col)
        result = metrics(scored_losses(df, scores, loss_options, id_col), None, loss_options)
        save_metrics(result, metrics_dir, {TRAIN: "train", TEST: "eval"}.get(name, f"eval_{name}"), run)


def preview_rows(df: DataFrame, id_col: str = "traj_id", seed: int = 42) -> DataFrame:
    """The rows with the key of the seeded preview order."""
    return df.withColumn("preview_key", order_key(seed, F.col(id_col)))
