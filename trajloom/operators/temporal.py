"""Joins and sessions by time, for keys of any size.

Rows are placed by ranges of (key, time), which split a key wherever it gets too long.
Each range is worked through in order in its own task; what it leaves open at its borders is
one or two rows, and only those short lists are put in order in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trajloom.operators.lookup import fits_broadcast, lookup_join, shuffle_partitions
from trajloom.operators.store import store

#: Interval lengths are classed by powers of this number.
LEVEL_FACTOR = 4.0


def _changes(columns: list[pa.ChunkedArray], before: list | None) -> np.ndarray:
    """Whether each row's key differs from the row before; the first is compared with ``before``."""
    out = np.zeros(len(columns[0]), bool)
    for k, column in enumerate(columns):
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False) if len(column) > 1 else False
        out[0] |= before is None or column[0].as_py() != before[k]
    return out


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as rows without one of the sides need it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _nullable(kind.valueType))
    return kind


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: list[str],
    prefix: str = "right_",
    ranges: int | None = None,
) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` that has its key and no later time.

    The columns of ``right`` apart from ``by`` are added under ``prefix``, null where there is no
    such row; all rows of ``left`` stay. Null keys and times match nothing. Of several right
    rows with one key and time the one that sorts last by its other columns counts. Right rows
    that a range needs from earlier ones are handed on, one per range.
    """
    values = [c for c in right.columns if c not in by]
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) if c in floats else F.col(c).isNotNull()
    floats = {f.name for df in (left, right) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    whole = lambda columns: F.forall(F.array(*[usable(c) for c in columns]), lambda x: x)
    value_type = T.StructType([T.StructField(prefix + c, right.schema[c].dataType) for c in values])
    packed = F.struct(*[F.col(c).alias(prefix + c) for c in values])
    rows = F.struct(*left.columns)
    placed_left = left.where(whole([*by, left_time])).select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(value_type).alias("_right"), rows.alias("_left"))
    placed_right = right.where(whole([*by, right_time])).select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), packed.alias("_right"), F.lit(None).cast(left.schema).alias("_left"))
    # Right rows come first at equal times; equal left rows are spread by a hash.
    tie = F.when(F.col("_side") == 1, F.xxhash64("_left")).otherwise(0).alias("_tie")
    both = placed_left.unionByName(placed_right).withColumn("_tie", tie)
    order = [*by, "_time", "_side", "_right", "_tie"]
    both = both.repartitionByRange(ranges or shuffle_partitions(left.sparkSession), *order).sortWithinPartitions(*order).select(*by, "_side", "_right", "_left")
    result = _nullable(T.StructType([*both.schema.fields, T.StructField("_range", T.LongType()), T.StructField("_open", T.BooleanType()), T.StructField("_edge", T.BooleanType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number = to_arrow_schema(result), TaskContext.get().partitionId()
        first_key = last_key = None
        held = pa.nulls(1, schema.field("_right").type)  # the last right row of the key at hand

        def emit(keys: list[pa.Array], side, right_values, left_rows, is_open, edge: bool) -> pa.RecordBatch:
            n = len(left_rows)
            columns = [*keys, side, right_values, left_rows, pa.array([number] * n, pa.int64()), pa.array(is_open, pa.bool_()), pa.array([edge] * n, pa.bool_())]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in by]
            first_key = [k[0].as_py() for k in keys] if first_key is None else first_key
            change = _changes(keys, last_key)
            is_right = batch.column("_side").to_numpy() == 0
            at = np.arange(batch.num_rows)
            # Of each row: its last right row, and where its key begins, -1 if before the batch.
            seen = np.maximum.accumulate(np.where(is_right, at, -1))
            begin = np.maximum.accumulate(np.where(change, at, -1))
            source = np.where(seen >= np.maximum(begin, 0), seen + 1, np.where(begin < 0, 0, -1))
            pool = pa.concat_arrays([held, batch.column("_right").cast(held.type)])
            found = pool.take(pa.array(source, mask=source < 0))
            has_none = found.is_null().to_numpy(zero_copy_only=False)
            own = np.ones(batch.num_rows, bool)
            for k, value in zip(keys, first_key):
                own &= pc.equal(k, pa.scalar(value, k.type)).to_numpy(zero_copy_only=False)
            keep = pa.array(~is_right)
            columns = [c.filter(keep) for c in (batch.column("_side"), found, batch.column("_left"))]
            yield emit([k.filter(keep) for k in keys], *columns, (has_none & own)[~is_right], False)
            held, last_key = found.slice(batch.num_rows - 1, 1), [k[-1].as_py() for k in keys]
        if last_key is not None:
            keys = [pa.array([k], schema.field(c).type) for k, c in zip(last_key, by)]
            yield emit(keys, pa.nulls(1, pa.int32()), held, pa.nulls(1, schema.field("_left").type), [False], True)

    merged = store(both.mapInArrow(run, result), "asof")
    # One row per range: the last right row of its last key, which later ranges of the key may need.
    edges = merged.where("_edge").select("_range", *by, "_right")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = edges.withColumn("_handed", F.last("_right", ignorenulls=True).over(earlier))
    following = Window.partitionBy(F.lit(0)).orderBy("_range")
    handed = handed.select(F.lead("_range").over(following).alias("_range"), *[F.col(c).alias(f"_key_{c}") for c in by], "_handed")
    same_key = F.lit(True)
    for c in by:
        same_key = same_key & (F.col(c) == F.col(f"_key_{c}"))
    matched = merged.where("NOT _edge").join(F.broadcast(handed), "_range", "left")
    final = F.when(F.col("_open") & same_key, F.col("_handed")).otherwise(F.col("_right"))
    out = matched.select("_left", final.alias("_right")).select("_left.*", *[F.col(f"_right.{prefix + c}").alias(prefix + c) for c in values])
    rest = left.where(~whole([*by, left_time])).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in values])
    return out.unionByName(rest)


def _number(column: str, df: DataFrame) -> Column:
    """A time (in seconds) or number as a double that never falls where the column rises."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1e6
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        # Apart from any time zone, whose clocks go back.
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0
        seconds = F.extract(F.lit("SECOND"), c).cast("double") + F.minute(c) * 60 + F.hour(c) * 3600
        return days if isinstance(kind, T.DateType) else days + seconds
    return c.cast("double")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    by: list[str] | None = None,
    unit: float | None = None,
    broadcast_bytes: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Each point with each interval that covers it: ``start <= at < end``, and equal ``by``.

    An interval belongs to a level by its length and lies in one or two bins of that level,
    however long it is; a point meets the bins it lies in, one per level that occurs, so a pair
    meets once. ``unit`` is the width of the lowest level's bins, by default the shortest
    interval. Bins with many points are spread over salts. Columns must differ apart from
    ``by``; intervals that end before they start, and nulls, match nothing.
    """
    by = by or []
    given = lambda columns: F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)
    spans = intervals.where(given([*by, start, end]) & (F.col(start) < F.col(end)))
    spans = spans.withColumns({"_from": _number(start, intervals), "_to": _number(end, intervals)})
    length = F.col("_to") - F.col("_from")
    unit = unit or spans.agg(F.min(F.when(length > 0, length))).first()[0] or 1.0
    level = F.greatest(F.ceil(F.log(F.greatest(length / unit, F.lit(1.0))) / F.log(F.lit(LEVEL_FACTOR))).cast("int"), F.lit(0))
    width = lambda c: F.lit(unit) * F.pow(F.lit(LEVEL_FACTOR), c)
    bins = lambda c: F.floor(F.col(c) / width(F.col("_level"))).cast("long")
    spans = spans.withColumn("_level", level)
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # a double has few powers
    spans = store(spans.withColumn("_bin", F.explode(F.sequence(bins("_from"), bins("_to")))).drop("_from", "_to"), "spans")
    rows = points.where(given([*by, at])).withColumn("_at", _number(at, points))
    rows = rows.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    rows = rows.withColumn("_bin", bins("_at")).drop("_at")
    small = fits_broadcast(spans) if broadcast_bytes is None else fits_broadcast(spans, broadcast_bytes)
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    pairs = lookup_join(rows, spans, [*by, "_level", "_bin"], [at, *[c for c in points.columns if c not in by]], small, **options)
    return pairs.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def sessions(
    rows: DataFrame,
    key: str,
    time: str,
    gap_seconds: float,
    sums: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per session of a key: runs of rows no more than ``gap_seconds`` apart.

    Gives key, session_start, session_end, rows and the sum of each of ``sums`` (as double,
    nulls left out, 0 if all are). Rows without key or time are in no session. A range adds up
    its sessions as it reads; its first and last one are merged with its neighbours'.
    """
    sums, kind = sums or [], rows.schema[time].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{time} must be a timestamp")
    gap = round(gap_seconds * 1e6)
    narrow = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    narrow = narrow.select(F.col(key).alias("key"), F.col(time).alias("at"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums])
    order = ["key", "at", *sums]
    placed = narrow.repartitionByRange(ranges or shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    result = T.StructType(
        [
            T.StructField("key", rows.schema[key].dataType), T.StructField("session_start", kind), T.StructField("session_end", kind),
            T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("rows", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in sums],
            T.StructField("_range", T.LongType()), T.StructField("_number", T.LongType()), T.StructField("_border", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, number = to_arrow_schema(result), TaskContext.get().partitionId(), 0
        held: list | None = None  # the session at hand, still open

        def emit(found: list[list], border: bool) -> pa.RecordBatch:
            nonlocal number
            full = [[*row, part, number + i, border or number + i == 0] for i, row in enumerate(found)]
            number += len(found)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column("key"), batch.column("at")
            micros = times.cast(pa.int64()).to_numpy()
            new = _changes([keys], None if held is None else [held[0]])
            new[1:] |= np.diff(micros) > gap
            new[0] |= held is None or micros[0] - held[4] > gap
            starts = np.flatnonzero(new)
            starts = starts if new[0] else np.concatenate([[0], starts])
            ends = np.append(starts[1:], batch.num_rows) - 1
            totals = [np.add.reduceat(batch.column(c).to_numpy(), starts).tolist() for c in sums]
            at = [c.take(pa.array(i)).to_pylist() for c, i in ((keys, starts), (times, starts), (times, ends))]
            columns = [*at, micros[starts].tolist(), micros[ends].tolist(), (ends - starts + 1).tolist(), *totals]
            found = [list(row) for row in zip(*columns)]
            if held is not None:
                if new[0]:
                    found.insert(0, held)
                else:
                    first = found[0]
                    found[0] = [held[0], held[1], first[2], held[3], first[4], *(a + b for a, b in zip(held[5:], first[5:]))]
            held = found.pop()
            if found:
                yield emit(found, False)
        if held is not None:
            yield emit([held], True)

    partial = store(placed.mapInArrow(run, result), "sessions")
    # At most two per range.
    border = partial.where("_border")
    line = Window.partitionBy(F.lit(0)).orderBy("_range", "_number")
    goes_on = (F.lag("key").over(line) == F.col("key")) & (F.col("_from") - F.lag("_to").over(line) <= gap)
    # A session inside a range parts the range's first from its last one.
    follows = F.lag("_range").over(line) != F.col("_range")
    joined = border.withColumn("_new", F.when(goes_on & follows, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(line))
    merged = joined.groupBy("_group").agg(
        F.first("key").alias("key"), F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums]
    )
    columns = ["key", "session_start", "session_end", "rows", *sums]
    return partial.where("NOT _border").select(*columns).unionByName(merged.select(*columns)).withColumnRenamed("key", key)
