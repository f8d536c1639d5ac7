"""Vocabulary, encoding and model inputs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.functions.tokens import model_inputs, model_prompt, split_tokens
from trajloom.operators.indexing import range_positions
from trajloom.operators.lookup import BROADCAST_BYTES, HOT_ROWS, fits_broadcast, lookup_join
from trajloom.operators.store import store
from trajloom.options import FIRST_TOKEN_ID, UNK_ID, TokenOptions


def build_vocabulary(df: DataFrame, columns: list[str], first_id: int = FIRST_TOKEN_ID) -> DataFrame:
    """Distinct tokens with their count ``n`` and a dense ``token_id``, most frequent first.

    The ranked table is written, so encoding can read it more than once.
    """
    words = F.concat(*[F.coalesce(split_tokens(F.col(c)), F.array().cast("array<string>")) for c in columns])
    counts = (
        df.select(F.explode(words).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = range_positions(counts, [F.desc("n"), F.asc("token")])
    return ranked.select("token", "n", (F.col("position") + first_id).cast("int").alias("token_id"))


def encode(
    df: DataFrame,
    columns: list[str],
    vocabulary: DataFrame,
    unk_id: int = UNK_ID,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``<column>_ids`` for each text column, row by row: ids of rows play no part.

    A vocabulary whose measured size is within the limit goes to all tasks, and each row
    is encoded where it lies, on Arrow batches. With a larger one the rows are written with
    a number of their own, only their tokens are joined, and the lists come back by number.
    """
    table = vocabulary.select("token", "token_id")
    if fits_broadcast(table, broadcast_bytes):
        lookup = token_lookup(table.toArrow(), unk_id)
        return df.withColumns({f"{c}_ids": lookup(_words(c)) for c in columns})
    rows = store(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    pieces = F.concat(*[_numbered(i, column) for i, column in enumerate(columns)])
    tokens = rows.select("_row", F.inline(pieces))
    found = lookup_join(tokens, table, ["token"], ["_row", "field", "pos"], False, hot_rows)
    item = F.struct("field", "pos", F.coalesce("token_id", F.lit(unk_id)).alias("id"))
    coded = found.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    joined = rows.join(coded, "_row", "left")
    return joined.withColumns({f"{c}_ids": _ids_of(i) for i, c in enumerate(columns)}).drop("_row", "_items")


def token_lookup(table: pa.Table, unk_id: int) -> Callable[[Column], Column]:
    """A function from lists of tokens to lists of ids, over whole Arrow batches at a time."""
    words = table["token"].combine_chunks()
    ids = pa.concat_arrays([*table["token_id"].cast(pa.int32()).chunks, pa.array([unk_id], pa.int32())])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lookup(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        at = pc.index_in(flat, words)
        found = ids.take(pc.fill_null(at, len(words)))
        sizes = pc.fill_null(pc.list_value_length(tokens), 0)
        ends = pc.cumulative_sum(sizes.cast(pa.int64()))
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends]).cast(pa.int32())
        return pa.ListArray.from_arrays(offsets, found)

    return lookup


def _words(column: str) -> Column:
    return F.coalesce(split_tokens(F.col(column)), F.array().cast("array<string>"))


def _numbered(field: int, column: str) -> Column:
    return F.transform(
        _words(column),
        lambda word, pos: F.struct(
            F.lit(field).alias("field"), pos.alias("pos"), word.alias("token")
        ),
    )


def _ids_of(field: int) -> Column:
    mine = F.filter("_items", lambda item: item["field"] == field)
    return F.coalesce(F.transform(mine, lambda item: item["id"]), F.array().cast("array<int>"))


def with_model_inputs(df: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """Add the token lists of the model from ``prompt_ids`` and ``response_ids``."""
    return df.withColumns(model_inputs(F.col("prompt_ids"), F.col("response_ids"), options))


def truncation_audit(df: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """Which responses lost tokens to ``max_length`` while their NLL covers all of them."""
    prompt_len = F.size(model_prompt(F.col("prompt_ids"), options))
    room = F.greatest(F.lit(options.max_length) - prompt_len, F.lit(0))
    kept = F.least(F.size("response_ids"), room)
    return df.withColumns(
        {
            "response_tokens": F.size("response_ids"),
            "response_kept": kept,
            "response_cut": kept < F.size("response_ids"),
        }
    )
