"""Metrics kept up to date by the changes between two snapshots of a buffer.

A state holds, per group, sums that can be taken back: finite values as fixed-point numbers,
whose sums do not hang on order or history, and counts of the values that are not finite. So
additions and retractions give, to the last bit, the state of a full run over the new snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajloom.functions.metrics import metric_values
from trajloom.options import LossOptions

#: Copies of a row that came (above 0) or went (below 0).
CHANGE = "_change"
# Twelve digits after the point, 14 before it, times up to 10**11 copies: exact in 38 digits.
FIXED, COPIES = "decimal(26,12)", "decimal(11,0)"


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The multiset difference both ways: each row that has more or fewer copies, with ``_change``.

    Equal rows are combined before the shuffle, so a row with any number of copies is fine. Null
    equals null and NaN equals NaN. The snapshots must have the same columns and types.
    """
    kinds = [{f.name: f.dataType for f in df.schema.fields} for df in (old, new)]
    if kinds[0] != kinds[1]:
        odd = sorted(c for c in {*kinds[0], *kinds[1]} if kinds[0].get(c) != kinds[1].get(c))
        raise ValueError(f"the snapshots differ in the columns {', '.join(odd)}")
    if CHANGE in old.columns:
        raise ValueError(f"a snapshot may have no column `{CHANGE}`")
    both = old.withColumn(CHANGE, F.lit(-1)).unionByName(new.withColumn(CHANGE, F.lit(1)))
    return both.groupBy(*old.columns).agg(F.sum(CHANGE).alias(CHANGE)).where(F.col(CHANGE) != 0)


def _parts(name: str, value: Column, copies: Column) -> list[Column]:
    infinite = F.abs(value) == float("inf")
    finite = value.isNotNull() & ~F.isnan(value) & ~infinite
    counted = {"n": value.isNotNull(), "nan": F.isnan(value), "up": value == float("inf"), "down": value == float("-inf")}
    total = F.sum(F.when(finite, value.cast(FIXED) * copies.cast(COPIES)).otherwise(F.lit(0).cast("decimal(38,12)")))
    return [
        total.cast("decimal(38,12)").alias(f"{name}_sum"),
        # NaN is above every number, also above infinity, and not equal to it.
        *[F.sum(F.when(test, copies).otherwise(0)).alias(f"{name}_{part}") for part, test in counted.items()],
    ]


def metric_state(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state of rows with loss columns, per group; rows with ``_change`` count that often.

    A finite value of 10**14 or more does not fit and fails the job.
    """
    copies = F.col(CHANGE) if CHANGE in df.columns else F.lit(1).cast("bigint")
    values = metric_values("origin_is_negative" in df.columns)
    parts = [part for name, value in values.items() for part in _parts(name, value, copies)]
    return df.groupBy(*by).agg(F.sum(copies).alias("samples"), *parts)


def updated_state(state: DataFrame, changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state after the changes, themselves a state. A group without rows goes.

    Taking back more rows of a group than it has is an error.
    """
    parts = [c for c in state.columns if c not in by]
    kinds = {f.name: f.dataType for f in state.schema.fields}
    sums = state.unionByName(changes).groupBy(*by).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in parts])
    wrong = F.raise_error(F.lit("a group loses more rows than it has")).cast("boolean")
    kept = F.when(F.col("samples") < 0, wrong).otherwise((F.col("samples") > 0) if by else F.lit(True))
    return sums.where(kept)


def metrics_of_state(state: DataFrame, by: Sequence[str] = (), options: LossOptions = LossOptions()) -> DataFrame:
    """The columns of :func:`trajloom.operators.metrics.metrics`."""
    names = [c.removesuffix("_sum") for c in state.columns if c.endswith("_sum") and c not in by]

    def mean(name: str) -> Column:
        up, down, nan = (F.col(f"{name}_{part}") > 0 for part in ("up", "down", "nan"))
        finite = F.col(f"{name}_sum").cast("double") / F.nullif(F.col(f"{name}_n"), F.lit(0))
        return F.when(nan | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(finite)

    return state.select(
        *by, F.coalesce("samples", F.lit(0)).alias("samples"), *[mean(name).alias(name) for name in names],
        F.when(F.col("samples") > 0, float(options.length_normalize)).alias("length_normalize"),
    )
