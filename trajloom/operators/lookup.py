"""Left joins to a table with one row per key, safe for hot keys.

A table whose measured size is within the limit is broadcast. A larger one is joined
by shuffle, and the keys that hold most rows are spread over salts: their rows in
the large table get a random-looking salt, their row in the lookup table one copy
per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.operators.store import store

BROADCAST_BYTES = 32 * 1024 * 1024
# Rows of a key that one task may always take.
HOT_ROWS = 100_000
# A key is hot if it holds more than this part of a partition's fair share of rows, so
# there are at most SHARES * partitions hot keys, whatever the data.
SHARES = 4


def measured_bytes(table: DataFrame) -> int:
    """Size of the rows in memory, measured; one small aggregate over the table."""
    per_row, texts = 16, []
    for field in table.schema.fields:
        per_row += 16
        if isinstance(field.dataType, T.StringType):
            texts.append(F.sum(F.octet_length(field.name)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            texts.append(F.sum(F.octet_length(F.to_json(F.struct(field.name)))))
    rows, *lengths = table.agg(F.count(F.lit(1)), *texts).first()
    return rows * per_row + sum(length or 0 for length in lengths)


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(table) <= limit


def hot_keys(rows: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more rows than one task should take, and the salts that spread them.

    Each salt of a key gets about as many rows as the threshold: ``min_rows``, or the
    SHARES-th part of a partition's share of all rows if that is more.
    """
    spark = rows.sparkSession
    counts = rows.where(_no_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = store(counts, "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    threshold = max(min_rows, -(-total // (SHARES * shuffle_partitions(spark))))
    hot = counts.where(F.col("_n") > threshold)
    return store(hot.select(*keys, F.ceil(F.col("_n") / threshold).cast("int").alias("_salts")), "hot-keys")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: list[str],
    broadcast: bool,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``rows`` to ``table`` on ``keys``.

    ``broadcast`` is the result of :func:`fits_broadcast`; ``spread`` names columns
    that tell rows of one key apart. All rows are kept, null keys too. ``counted`` holds
    the same keys as ``rows`` where those are dear to compute.
    """
    if broadcast:
        return rows.join(F.broadcast(table), keys, "left")
    hot = F.broadcast(hot_keys(rows if counted is None else counted, keys, hot_rows))
    # Null keys match nothing; salted too, they do not pile up in one task.
    salts = F.when(_no_null(keys), F.col("_salts")).otherwise(SHARES * shuffle_partitions(rows.sparkSession))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), salts), F.lit(0)).cast("int")
    salted_rows = rows.join(hot, keys, "left").withColumn("_salt", salt)
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_table = table.join(hot, keys, "left").withColumn("_salt", F.explode(copies))
    return (
        salted_rows.drop("_salts")
        .join(salted_table.drop("_salts"), [*keys, "_salt"], "left")
        .drop("_salt")
    )


def _no_null(keys: list[str]):
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition
