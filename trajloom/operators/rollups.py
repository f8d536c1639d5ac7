"""Exact distinct counts on every level of a roll-up, from bitmaps over dense ids.

Rows are read once and combined to (group, value). Each distinct value gets a dense id, each
group one bitmap per 32 768 ids, and a coarser level is the OR of the bitmaps below it. So no
row is multiplied by the number of levels, and no group's values have to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.operators.indexing import range_positions
from trajloom.operators.store import store

COMPARED_AS_TEXT = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def value_digest(df: DataFrame, value: str) -> Column:
    """32 bytes (SHA-256) that stand for a value, so that long texts are not moved; null stays null."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.sha2(F.col(value), 256))
    if not isinstance(kind, COMPARED_AS_TEXT):
        raise TypeError(f"`{value}` is {kind.simpleString()}; distinct values must be texts, bytes, whole numbers, flags or times")
    return F.unhex(F.sha2(F.col(value).cast("string"), 256))


def distinct_rollup(df: DataFrame, by: list[str], value: str, alias: str = "distinct") -> DataFrame:
    """(by..., level, samples, alias): rows and distinct values per group and for each coarser level.

    ``level`` is the one of SQL's ``GROUPING`` over ``by``: 0 for the finest groups. A null value
    is no value, a null in ``by`` is a group. An empty table has a total of 0 and no group.
    """
    pairs = store(df.groupBy(*by, value_digest(df, value).alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "group-values")
    known = pairs.where(F.col("_key").isNotNull())
    # Ids follow a value's first group: a group's ids lie together, so its bitmaps are few and full.
    first = known.groupBy("_key").agg(F.min(F.struct(F.lit(0).alias("_0"), *by)).alias("_first"))
    numbered = range_positions(first, [*[F.col("_first").getField(c) for c in by], F.col("_key")])
    # The bitmap functions count buckets and bits from the number 1 on.
    at = F.col("position") + 1
    bits = known.join(numbered.select("_key", "position"), "_key").groupBy(*by, F.bitmap_bucket_number(at).alias("_bucket"))
    finest = store(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")), "bitmaps")
    rows = store(pairs.groupBy(*by).agg(F.sum("_n").alias("_n")), "group-rows")

    levels, bitmaps = None, finest
    for kept in range(len(by), -1, -1):
        if kept < len(by):
            merged = bitmaps.groupBy(*by[:kept], "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
            bitmaps = store(merged, "bitmaps")
        group = [F.col(c) if c in by[:kept] else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by]
        level = F.lit((1 << (len(by) - kept)) - 1).cast("bigint").alias("level")
        zero = F.lit(0).cast("bigint")
        samples = rows.groupBy(*by[:kept]).agg(F.sum("_n").alias("samples")).withColumn(alias, zero)
        values = bitmaps.groupBy(*by[:kept]).agg(F.sum(F.bitmap_count("_bits")).alias(alias))
        for part in (samples, values.withColumn("samples", zero)):
            part = part.select(*group, level, "samples", alias)
            levels = part if levels is None else levels.unionByName(part)
    return levels.groupBy(*by, "level").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("samples", alias)])
