"""User functions on Arrow batches: row maps, batch functions and model scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import trajloom
from trajloom.options import TokenOptions

# Functions of this package travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(trajloom)

# Rows that a batch function's task gathers before it hands them back.
OUTPUT_ROWS = 10_000


def map_rows(
    df: DataFrame,
    fn: Callable[..., dict],
    schema: T.StructType,
    fn_kwargs: dict | None = None,
    remove_columns: list[str] | None = None,
) -> DataFrame:
    """Apply ``fn(row_dict, **fn_kwargs)``; its items are added to the row or replace columns.

    ``schema`` describes the columns that ``fn`` returns. Prefer built-in Columns where
    they can express the function: this one leaves the JVM.
    """
    kwargs, dropped = fn_kwargs or {}, set(remove_columns or [])
    new = {field.name for field in schema.fields}
    kept = [f for f in df.schema.fields if f.name not in dropped and f.name not in new]
    result = T.StructType([*kept, *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(result)
        for batch in batches:
            rows = [{**row, **fn(row, **kwargs)} for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, result)


def encode_with(
    df: DataFrame, make_encoder: Callable[[], Callable[[str], list[int]]], columns: list[str]
) -> DataFrame:
    """Add ``<column>_ids`` from a user's tokenizer, made once per partition.

    All other columns pass through unchanged. A null text is an error that names its column.
    """
    added = [T.StructField(f"{c}_ids", T.ArrayType(T.IntegerType())) for c in columns]
    result = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            ids = []
            for c in columns:
                texts = batch.column(c)
                if texts.null_count:
                    raise ValueError(f"column {c} holds a null text, which has no tokens")
                ids.append(pa.array([list(encoder(t)) for t in texts.to_pylist()], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *ids], names=[*batch.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, result)


def map_batches(
    df: DataFrame,
    fn: Callable[[list[dict]], list[dict]],
    schema: T.StructType,
    keys: list[str],
    order: list[str] | None = None,
) -> DataFrame:
    """Apply ``fn(rows) -> rows`` to the rows of each batch, as a collator would see them.

    Rows come in the order of ``order``, by default ``position`` if there is such a column.
    Batches have a fixed number of rows. Each task gets whole batches one after the other
    and holds one at a time.
    """
    order = [c for c in ["position"] if c in df.columns] if order is None else order
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(arrow_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        rows = (row for batch in arrow_batches for row in batch.to_pylist())
        out: list[dict] = []
        for _, group in groupby(rows, key=itemgetter(*keys)):
            out.extend(fn(list(group)))
            if len(out) >= OUTPUT_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return placed.mapInArrow(run, schema)


def score_with(
    df: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    id_col: str = "traj_id",
    options: TokenOptions = TokenOptions(),
    batch_rows: int = 16,
) -> DataFrame:
    """(id, pos, token, token_logp) of completions under a user's causal model.

    The model, made once per partition, takes the padded ids and masks of up to
    ``batch_rows`` rows (row x position) and returns logits (row x position x token); with
    more positions than ids the last ones count. A row without scored tokens keeps one row
    of nulls, so that :func:`~trajloom.operators.policy.sequence_scores` loses nobody.
    """
    fields = [T.StructField("pos", T.IntegerType()), T.StructField("token", T.IntegerType()), T.StructField("token_logp", T.DoubleType())]
    schema = T.StructType([df.schema[id_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                lists = (part.column(c).to_pylist() for c in ("input_ids", "attention_mask", "labels"))
                row, pos, token, logp = score_rows(model, *lists, options)
                columns = [part.column(id_col).take(pa.array(row)), pos, token, logp]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "pos", "token", "token_logp"])

    needed = df.select(id_col, "input_ids", "attention_mask", "labels")
    return needed.mapInArrow(run, schema)


def padded(lists: list[list[int]], pad: int, width: int) -> np.ndarray:
    out = np.full((len(lists), width), pad, np.int64)
    for i, values in enumerate(lists):
        out[i, : len(values)] = values
    return out


def score_rows(model, ids, masks, labels, options: TokenOptions):
    """Row, position, token and log-prob of each scored token; nulls for rows without one."""
    width = max(map(len, ids), default=0)
    targets = padded(labels, options.label_pad_token_id, width)
    scored = targets != options.label_pad_token_id
    scored[:, :1] = False
    row, pos = np.nonzero(scored)
    token, logp = targets[row, pos], np.zeros(0)
    if len(row):
        logits = np.asarray(model(padded(ids, options.pad_id, width), padded(masks, 0, width)), float)[:, -width:]
        found = logits[row, pos - 1]
        top = found.max(axis=1)
        logp = found[np.arange(len(row)), token] - top - np.log(np.exp(found - top[:, None]).sum(axis=1))
    empty = np.flatnonzero(~scored.any(axis=1)) if width else np.arange(len(ids))
    order = np.argsort(np.concatenate([row, empty]), kind="stable")
    nulls = [None] * len(empty)
    columns = [[*row.tolist(), *empty.tolist()], [*pos.tolist(), *nulls], [*token.tolist(), *nulls], [*logp.tolist(), *nulls]]
    row, pos, token, logp = ([c[i] for i in order] for c in columns)
    return row, pa.array(pos, pa.int32()), pa.array(token, pa.int32()), pa.array(logp, pa.float64())
