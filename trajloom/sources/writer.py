"""Sinks: metric records and training sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def save_metrics(df: DataFrame, path: str, split: str, run: str | None = None, fmt: str = "json") -> None:
    """Write the metric rows of a split, and of a run if one is named.

    They take the place of what the same split and run wrote before; all else stays. The
    names are folders, ``run=.../split=...``, so a reader of ``path`` gets them as columns.
    """
    parts = {"split": split} if run is None else {"run": run, "split": split}
    for kind, name in parts.items():
        if not re.fullmatch(r"[\w.+-]+", name) or name.startswith("."):
            raise ValueError(f"a {kind} may have letters, digits and . _ + - in its name, not {name!r}")
    folder = "/".join([path.rstrip("/"), *(f"{kind}={name}" for kind, name in parts.items())])
    df.write.mode("overwrite").format(fmt).save(folder)


def save_training_set(df: DataFrame, path: str) -> None:
    """Write padded batches by epoch and shard; files are sorted by batch.

    Takes the result of :func:`trajloom.operators.batching.training_set`. Whole shards
    lie in one task, so each shard is one sorted file.
    """
    df.write.partitionBy("epoch", "shard").parquet(path)
