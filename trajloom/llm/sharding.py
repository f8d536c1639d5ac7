"""Sharding by a Feistel permutation of global row numbers.

Row number r of n rows goes to place p(r), a pseudo-random permutation of 0 .. n-1; the
shard is p(r) mod shards, the slot p(r) div shards. Shards hold equal counts (at most one
apart), and the place of any row, and the row of any place, is computed without a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import mix, running_sums, table

ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A seeded permutation of 0 .. n-1: a balanced Feistel network on the least even number
    of bits that holds n-1, applied again to each value that falls outside (cycle walking)."""

    n: int
    seed: int = 0
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, right: np.ndarray, k: int) -> np.ndarray:
        key = np.uint64((self.seed * 1_000_003 + k) % (1 << 64))
        return mix(right ^ mix(np.array([key]))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(left, k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return (left << half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), back)
        while len(outside := np.flatnonzero(x >= np.uint64(self.n))):
            x[outside] = self._once(x[outside], back)
        return x.astype(np.int64)

    def place(self, row) -> np.ndarray:
        """Places of row numbers, all below n."""
        return self._walk(row, False)

    def row(self, place) -> np.ndarray:
        """Row numbers of places: the inverse."""
        return self._walk(place, True)


def row_of(permutation: Permutation, shards: int, shard: int, slot: int) -> int:
    """The row number that lies in a shard's slot."""
    return int(permutation.row(np.array([slot * shards + shard]))[0])


def numbered(df: DataFrame, order: list[str], row: str = "row_number") -> DataFrame:
    """Add the global row number in the order of the columns, nulls first."""
    rows = df.withColumn("_one", F.lit(1).cast("long"))
    order = [F.col(c).asc_nulls_first() for c in order]
    return running_sums(rows, order, {row: "_one"}, name="numbered").drop("_one")


def shard_rows(df: DataFrame, shards: int, n: int, seed: int = 0, row: str = "row_number") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows numbered 0 .. n-1."""
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(numbers.to_numpy()), index=numbers.index)

    placed = df.withColumn("_place", place(F.col(row)))
    return placed.withColumns(
        {"shard": (F.col("_place") % shards).cast("int"), "slot": F.floor(F.col("_place") / shards).cast("long")}
    ).drop("_place")


def shard_documents(spark: SparkSession, sf_dir: str, shards: int = 16, seed: int = 0) -> DataFrame:
    """Each row of ``documents`` with its shard and slot; counts are at most one apart.

    Row numbers follow (doc_id, checksum, size), null ids first; rows that agree in all
    three are interchangeable. A null text has size 1 and the checksum of the empty text.
    An empty table gives an empty result. Only ids, sizes and checksums are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = shard_rows(rows, shards, rows.count(), seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
