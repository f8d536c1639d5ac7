"""Stupid-backoff language model scores, computed by joins on n-gram hashes.

Documents are laid in blocks. Each block's distinct n-grams, with their counts, are cut by
hash into the buckets of the count tables; a bucket adds up the counts of all blocks and
answers each block with the totals of its n-grams. A block joined with its answers knows all
counts it needs and sums up the scores of its documents. An n-gram, however frequent, is one
entry per block, so no bucket gets more than its share. Entries travel as packed arrays.

Score of a word after its history: count(n-gram) / count(history) if the n-gram occurs at
least ``min_count`` times in the corpus, else ALPHA times the score with a history shorter
by a word; a word alone scores count / all words. Logarithms are natural.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import batch_words, mix, open_folder, shared_folder, slices, table, text_bytes, word_spans
from trajloom.operators.lookup import shuffle_partitions
from trajloom.operators.store import store

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: The registered query also gives the scores of this order, which the same counts yield.
LOWER_ORDER = 2
#: Blocks that a task scores, one after the other, once there are more than partitions.
TASK_BLOCKS = 4
BLOCK_BYTES = 8 << 20


def pack_array(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, packed: small numbers cost little."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpack_array(packed: bytes, dtype) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_array(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(packed, np.uint64), dtype=np.uint64)


def document_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, words, file, at, length): runs of documents with about BLOCK_BYTES of
    text, their number of words, and where their packed texts lie in a file of the shared
    folder. Texts are read there when needed and never shuffled; a repeated task writes a file of
    another name."""
    folder = shared_folder(docs.sparkSession, "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, ids, texts, size, at, sink = zstandard.ZstdCompressor(level=3), [], [], 0, 0, None
        file = f"{folder}/{uuid.uuid4().hex}.zst"

        def block() -> pa.RecordBatch:
            nonlocal at, sink
            if sink is None:
                files, path = open_folder(folder)
                files.create_dir(path, recursive=True)
                sink = open_folder(file)[0].open_output_stream(open_folder(file)[1], compression=None)
            packed = pack.compress(b"".join(texts))
            sink.write(packed)
            at += len(packed)
            words = sum(len(word_spans(np.frombuffer(t, np.uint8))[0]) for t in texts)
            columns = [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([words], pa.int64()),
                pa.array([file]),
                pa.array([at - len(packed)], pa.int64()),
                pa.array([len(packed)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "words", "file", "at", "length"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = text_bytes(part.column("text"))
                ids, texts, size = ids + part.column("doc_id").to_pylist(), texts + found, size + sum(map(len, found))
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()
        if sink is not None:
            sink.close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "ids array<long>, sizes array<long>, words long, file string, at long, length long")
    return store(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def block_texts(row) -> bytes:
    """The packed texts of a block."""
    files, path = open_folder(row["file"])
    with files.open_input_file(path) as source:
        source.seek(int(row["at"]))
        return source.read(int(row["length"]))


def block_grams(sizes: np.ndarray, texts: bytes, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """First word of each document (and the end); for each order the hashes of its n-grams and
    the word each ends with."""
    raw = zstandard.ZstdDecompressor().decompress(texts)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    words, bounds = batch_words([raw[a:b] for a, b in zip(edges, edges[1:])])
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    grams, last = [(words, np.arange(len(words)))], words
    for k in range(2, order + 1):
        last = mix(np.concatenate([[np.uint64(k)], last[:-1]]).astype(np.uint64)) + words if len(words) else words
        at = np.flatnonzero(place >= k - 1)
        grams.append((mix(last[at]), at))
    return bounds, grams


def gram_counts(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(order, bucket, block, hashes, counts) of each block. Buckets are ranges of hashes, so a
    block's buckets, in order, are its sorted n-grams."""
    shift = np.uint64(64 - int(math.log2(buckets))) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, grams = block_grams(np.array(row["sizes"]), block_texts(row), order)
                for k, (hashes, _) in enumerate(grams, 1):
                    found, counts = np.unique(hashes, return_counts=True)
                    bucket = (found >> shift).astype(np.int64) if shift else np.zeros(len(found), np.int64)
                    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(cuts))
                    spans = [(cuts[b], cuts[b + 1]) for b in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * len(some), pa.int32()),
                            pa.array(some, pa.int32()),
                            pa.array([row["block"]] * len(some), pa.int64()),
                            pa.array([pack_sorted(found[a:b]) for a, b in spans], pa.binary()),
                            pa.array([pack_array(counts[a:b].astype("<u4")) for a, b in spans], pa.binary()),
                        ],
                        names=["order", "bucket", "block", "hashes", "counts"],
                    )

    texts = blocks.select("block", "sizes", "file", "at", "length")
    return texts.mapInArrow(run, "order int, bucket int, block long, hashes binary, counts binary")


def bucket_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of one bucket, for each block's n-grams in that block's order."""
    hashes = [unpack_sorted(h) for h in rows["hashes"]]
    counts = np.concatenate([unpack_array(c, "<u4") for c in rows["counts"]]).astype(np.float64)
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(at, counts)[at].astype("<u8")
    edges = np.cumsum([0, *map(len, hashes)])
    return pd.DataFrame(
        {"block": rows["block"], "order": rows["order"], "bucket": rows["bucket"], "totals": [pack_array(totals[a:b]) for a, b in zip(edges, edges[1:])]}
    )


def score_block(
    block: pd.DataFrame, answers: pd.DataFrame, order: int, words: int, alpha: float, min_count: int, lower: tuple[int, ...] = ()
) -> pd.DataFrame:
    """Scores of one block's documents; ``answers`` are the corpus counts of its n-grams.
    The models of the ``lower`` orders get columns of their own."""
    row = block.iloc[0]
    bounds, grams = block_grams(np.asarray(row["sizes"]), block_texts(row), order)
    answers = answers.sort_values(["order", "bucket"])
    scores, before = np.zeros(bounds[-1]), None
    sizes = np.diff(bounds)
    out = pd.DataFrame({"doc_id": pd.array(list(row["ids"]), "Int64") if len(sizes) else [], "n_words": sizes})
    for k, (hashes, at) in enumerate(grams, 1):
        own = answers.loc[answers["order"] == k, "totals"]
        totals = np.concatenate([unpack_array(t, "<u8") for t in own]).astype(float) if len(own) else np.zeros(0)
        _, place = np.unique(hashes, return_inverse=True)
        count = np.zeros(bounds[-1])
        count[at] = totals[place]
        if k == 1:
            scores = np.log(count / max(words, 1))
        else:
            kept = at[count[at] >= min_count]
            scores[at] += math.log(alpha)
            scores[kept] = np.log(count[kept] / before[kept - 1])
        before = count
        if k == order or k in lower:
            sums, some, end = np.zeros(len(sizes)), np.flatnonzero(sizes), "" if k == order else f"_{k}"
            if len(some):
                sums[some] = np.add.reduceat(scores, bounds[some])
            out[f"log_score{end}"] = sums
            out[f"mean_score{end}"] = [s / n if n else None for s, n in zip(sums, sizes)]
    return out


def score_documents(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, lower: tuple[int, ...] = ()
) -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) of each row of ``docs`` (doc_id, text) under the
    model of all of them; for each of the ``lower`` orders k also log_score_k and mean_score_k.

    A text that is null, empty or without words has score 0 and no mean. Repeated rows count,
    and are scored, as often as they occur; ids may be null. An empty table gives an empty
    result.
    """
    blocks = document_blocks(docs)
    number, words = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    buckets = 1 << max(0, math.ceil(math.log2(max(number, 1))))
    # As many partitions as a task of a few blocks needs, however many the session sets.
    parts = max(shuffle_partitions(docs.sparkSession), -(-number // TASK_BLOCKS))
    answers = gram_counts(blocks, order, buckets).repartition(parts, "order", "bucket").groupBy("order", "bucket")
    answers = answers.applyInPandas(bucket_totals, "block long, order int, bucket int, totals binary")

    def score(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return score_block(block, own, order, words, alpha, min_count, lower)

    scored = blocks.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block"))
    ends = [f"_{k}" for k in sorted({*lower} - {order})] + [""]
    return scored.applyInPandas(score, "doc_id long, n_words long, " + ", ".join(f"log_score{e} double, mean_score{e} double" for e in ends))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` under the model of ORDER; log_score_2 and mean_score_2 are
    those of LOWER_ORDER."""
    rows = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), lower=(LOWER_ORDER,))
    return rows.select("doc_id", "n_words", "log_score", "mean_score", f"log_score_{LOWER_ORDER}", f"mean_score_{LOWER_ORDER}")
