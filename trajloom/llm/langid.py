"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit a binary naive Bayes classifier over hashed
byte trigrams tells the languages with a 1 from those with a 0. A text's bit margins are
compared with all codewords: the language with the least loss, each bit weighted by how
well its classifier knows that language, is chosen. A small lead over the second one
marks the text as ambiguous.

Trigram counts are made over all learning rows and combine in a shuffle of
(language, bucket) sums; the model has a fixed size per language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import LOWER, PIECE_BYTES, bounded_batches, slices, table, text_bytes

BUCKET_BITS = 15
SMOOTHING = 0.5
#: Beyond so many languages the code is random instead of exhaustive.
EXHAUSTIVE = 7
MAX_LANGUAGES = 2000
#: A lead of the best language below this marks a text as ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"
#: So many losses (text x language x bit) are held at once.
LOSSES = 1 << 18


def _fold() -> np.ndarray:
    """Lower case; ASCII other than letters becomes a space."""
    codes = np.arange(256)
    return np.where(((LOWER >= 97) & (LOWER <= 122)) | (codes >= 128), LOWER, 32).astype(np.uint8)


FOLD = _fold()


def trigram_buckets(texts: list[bytes], padded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of all texts, a space put before and behind each, and the
    first of each text (and the end). A text of n bytes has n trigrams. ``padded`` texts have
    the two spaces, or what stands around them, already."""
    if not padded:
        texts = [b" " + t + b" " for t in texts]
    buffer = FOLD[np.frombuffer(b"".join(texts), np.uint8)].astype(np.uint32)
    codes = (buffer[:-2] << 16) | (buffer[1:-1] << 8) | buffer[2:]
    buckets = (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) - 2
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    # Two trigrams lie across each border between texts.
    keep = np.ones(len(buckets), bool)
    borders = bounds[1:-1] + 2 * np.arange(len(texts) - 1)
    keep[borders] = keep[borders + 1] = False
    return buckets[keep], bounds


def runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts between two spaces, and parts of long ones, in lists of about PIECE_BYTES, each with
    the index of its first text. Parts overlap by two bytes, so each trigram is in one of them."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        whole = b" " + text + b" "
        if len(text) > PIECE_BYTES:
            if held:
                yield first, held
            for at in range(0, len(text), PIECE_BYTES):
                yield i, [whole[at : at + PIECE_BYTES + 2]]
            first, held, size = i + 1, [], 0
            continue
        held.append(whole)
        size += len(text)
        if size >= PIECE_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def count_trigrams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the rows (lang, text); one pass, sums combine per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts, langs = text_bytes(part.column("text")), part.column("lang").to_pylist()
                for lang in set(langs):
                    total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    for _, held in runs([t for t, own in zip(texts, langs) if own == lang]):
                        buckets, _ = trigram_buckets(held, padded=True)
                        total += np.bincount(buckets, minlength=1 << BUCKET_BITS)
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(total[found])], names=["lang", "bucket", "n"]
            )

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language: all ways to part a few languages in two, or random
    ones for many. No column is constant and no two rows are equal."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        columns = np.arange(1, 1 << (languages - 1))
        bits = (columns[None, :] >> np.arange(languages)[:, None]) & 1
        return np.where(bits, 1.0, -1.0)
    draw, width = np.random.default_rng(languages), math.ceil(10 * math.log2(languages))
    while True:
        code = np.where(draw.random((languages, width)) < 0.5, -1.0, 1.0)
        if len(np.unique(code, axis=0)) == languages and (np.abs(code.sum(0)) < languages).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bit x bucket: log odds of a bit given a trigram
    trust: np.ndarray  # language x bit, rows sum to 1

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean log odds of each bit per text."""
        totals, counts = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for first, held in runs(texts):
            buckets, bounds = trigram_buckets(held, padded=True)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            if len(some):
                # Bit by bit: the weights of all bits of all trigrams would take much memory at once.
                for bit, weights in enumerate(self.weights):
                    totals[first + some, bit] += np.add.reduceat(weights[buckets], bounds[some], dtype=np.float64)
            counts[first : first + len(held)] += sizes
        return totals / np.maximum(counts, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the least weighted loss, and its lead in 0 .. 1."""
        if len(self.languages) < 2:
            return np.zeros(len(margins), int), np.ones(len(margins))
        loss = np.zeros((len(margins), len(self.languages)))
        some = max(LOSSES // self.code.size, 1)
        for at in range(0, len(margins), some):
            of_bits = np.log1p(np.exp(-4 * margins[at : at + some, None, :] * self.code[None]))
            loss[at : at + some] = (of_bits * self.trust[None]).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        return order[:, 0], np.clip(1 - best / np.maximum(second, 1e-12), 0, 1)


def fit(counts: DataFrame) -> Model:
    """The model of trigram counts (lang, bucket, n); languages in alphabetical order."""
    with bounded_batches(counts.sparkSession):
        if counts.select("lang").distinct().count() > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        # At most 2**BUCKET_BITS rows per language.
        found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    at = {lang: i for i, lang in enumerate(languages)}
    n = np.zeros((len(languages), 1 << BUCKET_BITS))
    n[found["lang"].map(at).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    code = codewords(len(languages))
    # Each language counts the same, however many rows it has.
    share = n / np.maximum(n.sum(1, keepdims=True), 1)
    floor = SMOOTHING / max(float(n.sum(1).mean()), 1.0) if len(n) else 1.0
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    log_odds = np.log((ones.T @ share) / np.maximum(ones.sum(0), 1)[:, None] + floor) - np.log((zeros.T @ share) / np.maximum(zeros.sum(0), 1)[:, None] + floor)
    known = np.maximum((share @ log_odds.T) * code, 1e-6)
    return Model(languages, code, np.ascontiguousarray(log_odds, np.float32), known / np.maximum(known.sum(1, keepdims=True), 1e-12))


def predict(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` and ``ambiguous`` of each row's ``text``.

    A text that is null or has no letter, or any text if no language was learned, is
    ``und`` with score 0. Only texts leave the JVM.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def run(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        rows, langs, scores = pa.RecordBatch.from_arrays([texts, lettered], names=["text", "lettered"]), [], [np.zeros(0)]
        for part in slices(rows, "text"):
            best, score = model.decode(model.margins(text_bytes(part.column("text"))))
            known = part.column("lettered").to_numpy(zero_copy_only=False) & bool(model.languages)
            langs += [model.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
            scores.append(np.where(known, score, 0.0))
        score = np.concatenate(scores)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=["lang_pred", "score", "ambiguous"])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return df.select(*keep, run(F.col("text"), lettered).alias("_found")).select(*keep, "_found.*")


def is_held_out(doc_id: Column) -> Column:
    """Every fourth document by the checksum of its id; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Model:
    """Fitted on all labelled rows that are not held out; rows without id are left out too."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    return fit(count_trigrams(docs.where(usable & ~is_held_out(F.col("doc_id"))).select("lang", "text")))


def identify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each row of ``documents``; null ids, repeated rows and further columns
    make no difference to a prediction. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = predict(docs.select("doc_id", "text"), learned(docs), ["doc_id"])
    return predicted.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
