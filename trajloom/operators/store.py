"""Intermediate tables written to the cluster's shared folder.

A table that is read several times, or whose values must not change between two
readings, is written once. Unlike a cached block it outlives a lost executor, and
unlike a row checkpoint it keeps column pruning and file statistics.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only if all runs in one JVM."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="trajloom-")
    return _local_dirs[app]


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/trajloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """For jobs: what is stored inside, and before it, is deleted at the end, also after errors."""
    try:
        yield
    finally:
        remove_stored(spark)


def remove_stored(spark: SparkSession) -> None:
    """Delete all tables this application has stored; call it once their readers are done."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write the table now and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
