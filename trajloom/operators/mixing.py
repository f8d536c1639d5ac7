"""Mixing experts' buffers by ratio: an exact, seeded quota of each buffer.

A buffer's rows are ordered by a seeded hash of their ids. The border of the first k rows is
found by counting: rows per leading digits, then, inside the one bucket that holds the border, per
further digits. No buffer is sorted; one small bucket is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.operators.indexing import BUCKET_DIGITS, order_key
from trajloom.operators.replay import mix_buffers

#: Rounds of counting; each tells BUCKET_DIGITS hex digits of the border.
ROUNDS = 2


def quotas(ratios: Mapping[str, float], available: Mapping[str, int], total: int | None = None) -> dict[str, int]:
    """Rows of each buffer: shares of ``total`` by largest remainder, ties by name.

    Without a total, the largest one for which every buffer has enough rows. A total that asks
    a buffer for more rows than it has is an error.
    """
    if not ratios or any(not r >= 0 or math.isinf(r) for r in ratios.values()) or not sum(ratios.values()) > 0:
        raise ValueError("ratios must be finite, none below 0 and one above")

    def shares(n: int) -> dict[str, int]:
        exact = {name: n * r / sum(ratios.values()) for name, r in ratios.items()}
        out = {name: math.floor(x) for name, x in exact.items()}
        for name in sorted(exact, key=lambda b: (out[b] - exact[b], b))[: n - sum(out.values())]:
            out[name] += 1
        return out

    def fits(n: int) -> bool:
        return all(k <= available[name] for name, k in shares(n).items())

    if total is None:
        total, top = 0, sum(available[name] for name, r in ratios.items() if r > 0)
        while total < top:
            middle = -(-(total + top) // 2)
            total, top = (middle, top) if fits(middle) else (total, middle - 1)
    elif not fits(total):
        short = {name: k for name, k in shares(total).items() if k > available[name]}
        raise ValueError(f"too few rows: {short} wanted of {({n: available[n] for n in short})}")
    return shares(total)


def _prefix_counts(df: DataFrame, digits: int) -> dict[str, int]:
    """Rows per prefix of the key; at most 16**BUCKET_DIGITS of them."""
    found = df.groupBy(F.substring("_key", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return {r["p"]: r["n"] for r in found.collect()}


def first_rows(df: DataFrame, counts: dict[str, int], k: int, ids: list[str]) -> DataFrame:
    """The k rows of smallest ``_key``; ``counts`` are those of its first BUCKET_DIGITS digits."""
    border, left = "", k
    for level in range(1, ROUNDS + 1):
        if level > 1:
            counts = _prefix_counts(df.where(F.col("_key").startswith(border)).select("_key"), level * BUCKET_DIGITS)
        for prefix in sorted(counts):
            if counts[prefix] > left:
                border = prefix
                break
            left -= counts[prefix]
        else:
            return df  # all rows
    below = df.where(F.substring("_key", 1, len(border)) < border)
    # About one row in 16**len(border); the constant key only says that they form one group.
    ranked = df.where(F.col("_key").startswith(border)).withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key", *ids)))
    return below.unionByName(ranked.where(F.col("_rank") <= left).drop("_rank"))


def mix_by_ratio(
    buffers: Mapping[str, DataFrame],
    ratios: Mapping[str, float],
    ids: list[str],
    total: int | None = None,
    seed: int = 42,
    domain: str = "domain",
) -> DataFrame:
    """Rows of several buffers in the given ratios, tagged with their domain.

    Of each buffer the :func:`quotas` rows with the smallest seeded keys stay, the same ones for
    any partitioning and on any engine. ``ids`` must tell a buffer's rows apart; rows whose
    ids are equal have equal keys, and which of them stay is open at the border. Buffers without
    a ratio are left out.
    """
    missing = sorted(set(ratios) - set(buffers))
    if missing:
        raise ValueError(f"no buffer for {', '.join(missing)}")

    def key(name: str) -> Column:
        return order_key(seed, F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])

    keyed = {name: buffers[name].withColumn("_key", key(name)) for name in ratios}
    counts = {name: _prefix_counts(df.select("_key"), BUCKET_DIGITS) for name, df in keyed.items()}
    wanted = quotas(ratios, {name: sum(c.values()) for name, c in counts.items()}, total)
    chosen = {name: first_rows(df, counts[name], wanted[name], ids) for name, df in keyed.items()}
    return mix_buffers(chosen, domain).drop("_key")
