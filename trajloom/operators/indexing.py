"""Dense row numbers without a window over the whole table.

Both operators number the rows inside buckets that follow the wanted order and add
the count of all rows in earlier buckets. Only the list of bucket counts, whose
length is fixed, is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.operators.store import store

# Four hex digits: 65 536 buckets of about equal size.
BUCKET_DIGITS = 4
# Fixed value: monotonically_increasing_id() keeps the partition above these bits.
ROW_BITS = 33


def order_key(seed: int, *parts: Column) -> Column:
    """The seeded order: md5 of ``seed:part:part…``, the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_positions(df: DataFrame, key: str, groups: list[str], digits: int = BUCKET_DIGITS) -> DataFrame:
    """Add ``position`` (0-based) and ``total`` per group, in the order of ``key``.

    ``key`` is a column of :func:`order_key` over unique ids. Its leading digits are
    the bucket, so buckets are even however the ids are distributed, and the result
    depends on the data only: nothing is sampled, nothing needs to be kept.
    """
    bucketed = df.withColumn("_bucket", F.substring(key, 1, digits))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("total"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(key)
    return (
        bucketed.join(offsets, [*groups, "_bucket"])
        .withColumn("position", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def range_positions(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Add ``position`` (0-based) in the order of any unique list of columns.

    Each range is sorted in its task, which numbers its rows as it writes them. Spark
    samples the range borders, so the table is written: all later readings see the same
    borders, and only add the number of rows in the ranges before.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # The id holds the task's range above ROW_BITS and the row's number in it below.
    ranged = store(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumns(
        {
            "_part": F.shiftright("_at", ROW_BITS),
            "_row": F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)),
        }
    )
    counts = ranged.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    # One row per range; the constant key only says that they form one group.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_offset") + F.col("_row"))
        .drop("_at", "_part", "_row", "_offset")
    )
