"""Trajectory sources: JSON or parquet file lists, and dataset directories."""

from __future__ import annotations

import logging
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.operators.enrich import ADVANTAGE, NLL, ORIGIN

logger = logging.getLogger(__name__)

# The separator of file lists and the markers of the two formats.
SEPARATOR = "||"
FORMAT_MARKERS = {".json": "json", ".parquet": "parquet"}

# The columns that later steps keep, besides the token lists.
KEPT_COLUMNS = ["prompt", "response", "nll_seq", "advantage", "origin_label"]
TRAIN, TEST = "train", "test"
# Columns that are numbers with a fraction, even where a file has whole ones only.
REAL_COLUMNS = (NLL, ADVANTAGE)
# Cards and info files that lie beside the data of a dataset.
SIDE_FILES = ["info.json", "dataset_info.json", "dataset_infos.json", "dataset_dict.json", "state.json", "metadata.json", "config.json"]
# The rightmost marker in a file's name.
NAME_FORMAT = r"^.*\.(json|parquet)"
URI_START = r"^[A-Za-z0-9+.-]+:(//[^/]*)?"
# The words that name a split in a file or folder name.
SPLIT_WORDS = {
    "train": ["train", "training"],
    "validation": ["validation", "valid", "dev", "val"],
    "test": ["test", "testing", "eval", "evaluation"],
}
SPLIT_WORD = rf"(?:^|[^A-Za-z0-9])({'|'.join(w for words in SPLIT_WORDS.values() for w in words)})(?:[^A-Za-z0-9]|$)"


def file_format(path: str) -> str | None:
    """``json`` or ``parquet`` by the rightmost marker in the path; None for a directory."""
    at, marker = max((path.rfind(marker), marker) for marker in FORMAT_MARKERS)
    return FORMAT_MARKERS[marker] if at >= 0 else None


def read_trajectories(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> dict[str, DataFrame]:
    """The splits found at ``path``: a ``||``-separated file list, or a directory.

    A file list is one bag of training rows. Required columns are checked here.
    """
    paths = path.split(SEPARATOR)
    formats = {file_format(p) for p in paths}
    if len(formats) > 1:
        raise ValueError(f"one file list must have one format: {path}")
    kind = formats.pop()
    if kind == "json":
        splits = {TRAIN: read_json(spark, paths, schema)}
    elif kind == "parquet":
        splits = {TRAIN: read_parquet(spark, paths)}
    else:
        splits = read_directory(spark, path, schema=schema)
    check_columns(splits[TRAIN], path)
    return {name: with_origin_column(df) for name, df in splits.items()}


def read_json(
    spark: SparkSession, paths: list[str], schema: T.StructType | None = None, **options
) -> DataFrame:
    """JSON lines, or files that hold one JSON array each (a task reads such a file whole).

    Without a schema all rows of all files give one, in a distributed pass; pass a schema to
    save it. Values that do not fit the schema fail the job instead of turning into nulls.
    """
    first = spark.read.text(paths, **options).where(F.trim("value") != "").first()
    arrays = first is not None and first[0].lstrip().startswith("[")
    if schema is None:
        schema = json_schema(spark, paths, arrays, **options)
    return spark.read.schema(schema).json(paths, mode="FAILFAST", multiLine=arrays, **options)


def json_schema(spark: SparkSession, paths: list[str], arrays: bool, **options) -> T.StructType:
    """The columns of all rows. Whole numbers stay whole, but for NLL and advantage."""
    found = spark.read.json(paths, mode="FAILFAST", multiLine=arrays, samplingRatio=1.0, **options)
    whole = T.LongType()
    return T.StructType(
        [
            T.StructField(f.name, T.DoubleType() if f.name in REAL_COLUMNS and f.dataType == whole else f.dataType)
            for f in found.schema
        ]
    )


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files as one bag; files with other columns are aligned by name."""
    tables = [spark.read.parquet(p, mergeSchema=True) for p in paths]
    if all(t.schema == tables[0].schema for t in tables):
        return spark.read.schema(tables[0].schema).parquet(*paths)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_directory(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None
) -> dict[str, DataFrame]:
    """A dataset directory. Files or folders named after a split hold that split.

    Training needs ``train``; ``test`` is used if there; ``validation`` files are left
    alone. The split is taken from the file path, so no data is read to find the
    splits, and a filter on the split skips the other files. Without any split name all
    rows are training rows. Cards and info files beside the data are not read.
    """
    files = spark.read.format("binaryFile").load(path, recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.lower("_metadata.file_name").alias("name"))
    files = files.withColumns({"format": F.regexp_extract("name", NAME_FORMAT, 1), "side": F.col("name").isin(SIDE_FILES)})
    root = directory_root(files, path)
    data = files.where((F.col("format") != "") & ~F.col("side"))
    # One row per format and split, however many files there are.
    kinds = data.select("format", split_column(F.col("file"), root).alias("split")).distinct().collect()
    formats = {k["format"] for k in kinds}
    fmt = fmt or (formats.pop() if len(formats) == 1 else None)
    if fmt is None:
        raise ValueError(f"{path} must hold JSON or parquet files, and of one kind")
    if fmt == "json":
        paths, options = [path], {"recursiveFileLookup": True, "pathGlobFilter": "*.json*"}
        if not files.where((F.col("format") == "json") & F.col("side")).isEmpty():
            # A glob can't leave files out, so the data files are named.
            paths, options = [row["file"] for row in data.toLocalIterator()], {}
        df = read_json(spark, [decoded_uri(p) for p in paths] if not options else paths, schema, **options)
    else:
        df = spark.read.parquet(path, recursiveFileLookup=True, mergeSchema=True, pathGlobFilter="*.parquet*")
    names = {k["split"] for k in kinds} - {None}
    if not names:
        return {TRAIN: df}
    if TRAIN not in names:
        raise ValueError(f"no training files in {path}")
    tagged = df.select("*", split_column(F.col("_metadata.file_path"), root).alias("_split"))
    return {name: select_split(tagged, name, "_split") for name in (TRAIN, TEST) if name in names}


def decoded_uri(uri: str) -> str:
    return unquote(uri)


def directory_root(files: DataFrame, path: str) -> str:
    """The directory as it begins the paths of its files, without scheme and host."""
    root = re.sub(URI_START, "", path).rstrip("/")
    if root.startswith("/"):
        return root
    first = files.first()
    if first is None:
        return root
    below = re.sub(URI_START, "", unquote(first["file"]))
    name = re.sub(r"^(\./)+", "", root)
    return below[: below.index(f"/{name}/") + len(name) + 1]


def split_column(file: Column, root: str) -> Column:
    """The split named by a word of a file's path below the root, if any."""
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    below = F.substring(F.regexp_replace(plain, URI_START, ""), len(root) + 1, 1 << 20)
    word = F.regexp_extract(below, SPLIT_WORD, 1)
    split = F.lit(None).cast("string")
    for name, words in SPLIT_WORDS.items():
        split = F.when(word.isin(words), name).otherwise(split)
    return split


def select_split(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    return df.where(F.col(split) == name).drop(split)


def check_columns(df: DataFrame, path: str) -> None:
    """The NLL column is required; a missing origin label means that all rows are positive."""
    if NLL not in df.columns:
        raise ValueError(f"{path} has no column `{NLL}`, which training needs")
    if ORIGIN not in df.columns:
        logger.warning("no column `%s`: every row counts as positive", ORIGIN)


def check_tokenised(df: DataFrame) -> None:
    """After tokenisation the NLL column must still be there."""
    if NLL not in df.columns:
        raise RuntimeError(f"encoding lost the column `{NLL}`")


def with_origin_column(df: DataFrame) -> DataFrame:
    if ORIGIN in df.columns:
        return df
    return df.withColumn(ORIGIN, F.lit(None).cast("string"))


def prune(df: DataFrame, extra: list[str]) -> DataFrame:
    """Only the columns that training reads, and ``extra``; Spark prunes the scan to them."""
    return df.select(*[c for c in df.columns if c in KEPT_COLUMNS or c in extra])
