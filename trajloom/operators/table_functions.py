"""Batch functions as table functions that SQL can call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_schema

import trajloom

cloudpickle.register_pickle_by_value(trajloom)


def register_batch_function(
    spark: SparkSession, name: str, fn: Callable[[list[dict]], list[dict]], schema: T.StructType
) -> None:
    """Make ``fn(rows) -> rows`` a table function of SQL that gets one batch at a time.

    ::

        SELECT * FROM name(TABLE(placed) PARTITION BY (epoch, batch_id) ORDER BY position)

    Spark places the rows by the PARTITION BY columns and sorts them by the others; a task holds
    one batch. ``fn`` is never called without rows. Its rows may leave out columns of ``schema``.
    Columns of the same name as another are an error, since a row is a dictionary.
    """
    arrow = to_arrow_schema(schema)

    class BatchFunction:
        def __init__(self) -> None:
            self.parts: list[pa.RecordBatch] = []

        def eval(self, batch: pa.RecordBatch) -> None:
            if batch.num_rows:
                self.parts.append(batch)

        def terminate(self) -> Iterator[pa.Table]:
            rows = [row for part in self.parts for row in part.to_pylist()]
            if rows:
                yield pa.Table.from_pylist(fn(rows), schema=arrow)

    spark.udtf.register(name, arrow_udtf(BatchFunction, returnType=schema))
