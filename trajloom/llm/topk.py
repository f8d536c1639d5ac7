"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors are cut into integers and laid in blocks, which are ranges of ids. A block keeps
the largest and the least value of each dimension (its terms' maxima, for query weights of
either sign) and a forward index: its vectors. For each query the blocks of a group are
visited by descending bound, the sum of the largest possible products; once a bound falls
below the k-th score, no later block of the group is scored. The best of all groups are
ranked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajloom.llm.common import table
from trajloom.operators.store import store

BLOCK = 512
#: Blocks that one task visits for a chunk of queries.
GROUP_BLOCKS = 32
CHUNK = 512
SCALE = 256.0
#: Sums of products below this are exact in a double.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null and whose components are finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & finite)


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Integer rows floor(256 x), zeros behind shorter vectors."""
    rows = [np.floor(SCALE * np.asarray(v, np.float64)) for v in column]
    width = max([0, *map(len, rows)]) if width is None else width
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : min(len(row), width)] = row[:width]
    return out


def make_blocks(vectors: DataFrame, id_col: str, column: str, size: int = BLOCK) -> DataFrame:
    """(block, ids, rows): runs of ``size`` vectors in the order of ids, written.

    Blocks never cross a range of the sort, so all but the last of a range are full.
    """
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"), F.xxhash64(column).alias("_tie"))
    ordered = ordered.repartitionByRange(partitions, "id", "_tie").sortWithinPartitions("id", "_tie").select("id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), pa.array([ids[:size]], pa.list_(pa.int64())), pa.array([rows[:size]], pa.list_(pa.list_(pa.float64())))],
                names=["block", "ids", "rows"],
            )

        for batch in batches:
            ids += batch.column("id").to_pylist()
            rows += batch.column("v").to_pylist()
            while len(ids) >= size:
                yield block()
                number, ids, rows = number + 1, ids[size:], rows[size:]
        if ids:
            yield block()

    return store(ordered.mapInArrow(run, "block long, ids array<long>, rows array<array<double>>"), "blocks")


def search_group(queries: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of the blocks for each query (query_id, query_key, v), ties to smaller ids."""
    query = matrix(queries["v"])
    own, keys = queries["query_id"].to_numpy(np.int64), queries["query_key"].to_numpy(np.int64)
    ids = [np.asarray(b, np.int64) for b in blocks["ids"]]
    rows = [matrix(b, query.shape[1]) for b in blocks["rows"]]
    top = max([np.abs(query).max(initial=0) * np.abs(r).max(initial=0) * query.shape[1] for r in rows], default=0)
    if top >= EXACT:
        # Beyond exact doubles: Python's integers.
        query, rows = _ints(query), [_ints(r) for r in rows]
        bounds = np.array([[np.sum(np.maximum(q * r.max(0), q * r.min(0))) for r in rows] for q in query], object)
    else:
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        bounds = np.stack([plus @ r.max(0) + minus @ r.min(0) for r in rows], 1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(query)
    best_score = np.full((n, k), -np.inf) if bounds.dtype != object else np.full((n, k), -(10**400), object)
    best_id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    live = np.ones(n, bool)
    for step in range(len(rows)):
        at = order[:, step]
        # A block whose bound equals the k-th score may still hold a smaller id.
        live &= np.take_along_axis(bounds, at[:, None], 1)[:, 0] >= best_score[:, -1]
        if not live.any():
            break
        for b in np.unique(at[live]):
            some = np.flatnonzero(live & (at == b))
            scores = query[some] @ rows[b].T
            same = ids[b][None, :] == own[some][:, None]
            scores = np.where(same, best_score.dtype.type(-np.inf) if scores.dtype != object else -(10**400), scores)
            all_scores = np.concatenate([best_score[some], scores], 1)
            all_ids = np.concatenate([best_id[some], np.broadcast_to(ids[b], scores.shape)], 1)
            if scores.dtype != object and all_scores.shape[1] > 8 * k:
                # Keep all that tie with the k-th before the exact ranking.
                edge = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
                rank = [np.flatnonzero(s >= e) for s, e in zip(all_scores, edge)]
            else:
                rank = [np.arange(all_scores.shape[1])] * len(some)
            for i, j, s, d in zip(some, rank, all_scores, all_ids):
                chosen = j[np.lexsort((d[j], -s[j]))[:k]] if s.dtype != object else np.array(sorted(j, key=lambda x: (-s[x], d[x]))[:k])
                best_score[i], best_id[i] = s[chosen], d[chosen]
    found = best_score > (-np.inf if best_score.dtype != object else -(10**400))
    if best_score.dtype == object:
        for i, j in zip(*np.nonzero(found)):
            if not -(1 << 63) <= best_score[i, j] < 1 << 63:
                raise OverflowError(f"the score of query {own[i]} and vector {best_id[i, j]} does not fit a long")
    return pd.DataFrame(
        {"query_id": np.repeat(own, found.sum(1)), "query_key": np.repeat(keys, found.sum(1)), "vec_id": best_id[found], "score": [int(s) for s in best_score[found]]}
    ).astype({"query_id": "int64", "query_key": "int64", "vec_id": "int64"})


def _ints(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest integer inner products.

    A candidate never has the query's own id. Rows without an id take no part as candidates
    or queries; repeated ids are candidates each, and queries each give ranks of their own.
    Shorter vectors count as followed by zeros. A score among the k best that no long holds is an
    error that names both ids. Empty tables give an empty result. Every chunk of queries meets every group of
    blocks once, on a key of both; what leaves a group is k rows per query.
    """
    blocks = make_blocks(usable(vectors, column).where(F.col(id_col).isNotNull()), id_col, column)
    asked = usable(queries, column).where(F.col(id_col).isNotNull())
    asked = asked.select(F.col(id_col).alias("query_id"), F.col(column).cast("array<double>").alias("v"))
    asked = store(asked.withColumn("query_key", F.monotonically_increasing_id()), "queries")
    block_count, query_count = blocks.count(), asked.count()
    groups, chunks = -(-block_count // GROUP_BLOCKS), -(-query_count // CHUNK)
    numbered = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(max(groups, 1))).cast("int"))
    numbered = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_key"), F.lit(max(chunks, 1))).cast("int"))
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))))

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype("int64")
        return search_group(q, b, k)

    best = asked.groupBy("group", "chunk").cogroup(numbered.groupBy("group", "chunk"))
    best = best.applyInPandas(run, "query_id long, query_key long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
  CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
