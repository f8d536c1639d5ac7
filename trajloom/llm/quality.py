"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

One pass over the texts measures each document and each of its lines; a line's measures are
put into steps, and the combination of steps is its kind, one of a few thousand. Labelled
documents train the field by pseudo-likelihood: what a line is, given its kind and its
neighbours, hangs on counts of (kind, neighbours, label) alone, which Spark adds up over all
labelled documents; the driver sees that table, whose size is fixed. Viterbi decoding
then gives each text its most likely sequence, and the share of words in content decides.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import slices, table, text_bytes
from trajloom.operators.lookup import fits_broadcast, lookup_join
from trajloom.operators.store import store

#: Fixed rules.
LEAST_WORDS = 50
MOST_REPEATED = 0.5
WINDOW = 3
#: A document whose content holds a smaller share of its words goes.
LEAST_CONTENT = 0.5
PENALTY = 1.0
PART_BYTES = 1 << 22

#: Measures of a line and the steps of each: a value counts the steps that it has reached.
STEPS: dict[str, list[float]] = {
    "symbols per character": [1e-9, 0.05, 0.15],
    "capitals per letter": [0.3, 0.6],
    "exclamations per word": [1e-9, 0.3],
    "words like the one before, per word": [1e-9, 0.3],
    "digits per character": [0.1, 0.3],
    "words": [2, 5, 16],
    "like an earlier line": [1],
    "ends a sentence": [1],
}
SIZES = [len(s) + 1 for s in STEPS.values()]
KINDS = int(np.prod(SIZES))
NO_WORD = -1


def _classes() -> dict[str, np.ndarray]:
    codes = np.arange(256)

    def among(characters: bytes) -> np.ndarray:
        return np.isin(codes, list(characters))

    return {
        "space": among(b" \t\n\v\f\r"),
        "symbol": among(b"#*$%&|<>"),
        "upper": (codes >= 65) & (codes <= 90),
        "lower": (codes >= 97) & (codes <= 122),
        "exclamation": among(b"!"),
        "digit": (codes >= 48) & (codes <= 57),
        "stop": among(b".!?:;\"'"),
        "character": (codes & 0xC0) != 0x80,
    }


CLASSES = _classes()


def word_numbers(buffer: bytes) -> np.ndarray:
    """A number for each word, the same for equal words only; cut at spaces, to hold few at once."""
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(buffer):
        end = min(at + PART_BYTES, len(buffer))
        while end < len(buffer) and not CLASSES["space"][buffer[end]]:
            end += 1
        found.append(np.fromiter(map(numbers.__getitem__, buffer[at:end].split()), np.int64))
        at = end
    return np.concatenate(found)


def joint_key(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row, the same for rows equal in all columns (of numbers from 0) only."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        width = int(column.max(initial=0)) + 1
        if size * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = len(key)
        key, size = key * width + column, size * width
    return key


def repeated_words(words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of words that its text holds at least twice."""
    found, number = np.zeros(len(words), bool), len(words) - WINDOW + 1
    if number <= 0:
        return found
    starts = np.flatnonzero(text_of[:number] == text_of[WINDOW - 1 :])
    if len(starts):
        key = joint_key([text_of[starts], *(words[starts + k] for k in range(WINDOW))])
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        for k in range(WINDOW):
            found[starts[counts[which] > 1] + k] = True
    return found


def earlier_lines(text: bytes) -> list[bool]:
    """Whether each line has a word and equals an earlier line."""
    seen: set[bytes] = set()
    out = []
    for line in text.split(b"\n"):
        out.append(line in seen and not (not line or line.isspace()))
        seen.add(line)
    return out


@dataclass
class Measures:
    """Sums of each text, the kind and words of each line, and the first line of each text (and the end)."""

    sums: dict[str, np.ndarray]
    kinds: np.ndarray
    line_words: np.ndarray
    bounds: np.ndarray


def measure(texts: list[bytes]) -> Measures:
    buffer = b"\n".join(texts) + b"\n"
    codes = np.frombuffer(buffer, np.uint8)
    line_ends = np.flatnonzero(codes == 10)
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lines)])
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    count = {c: np.add.reduceat(CLASSES[c][codes], line_starts, dtype=np.int64) for c in CLASSES}
    space = CLASSES["space"][codes]
    word_starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    words = word_numbers(buffer)
    line_of = np.searchsorted(line_starts, word_starts, "right") - 1
    text_of = np.repeat(np.arange(len(texts)), lines)[line_of]
    repeated = repeated_words(words, text_of)
    like_last = np.concatenate([[False], (words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1])])[: len(words)]
    n_words, n_lines = np.bincount(line_of, minlength=len(line_ends)), len(line_ends)
    earlier = np.fromiter(itertools.chain.from_iterable(map(earlier_lines, texts)), bool, n_lines)
    # Each byte's last byte that is no space, at the end of its line.
    last = np.maximum.accumulate(np.where(space, 0, np.arange(len(codes))))[line_ends]
    characters = count["character"] - count["space"]
    some_words, some_characters = np.maximum(n_words, 1), np.maximum(characters, 1)
    values = [
        count["symbol"] / some_characters,
        count["upper"] / np.maximum(count["upper"] + count["lower"], 1),
        count["exclamation"] / some_words,
        np.bincount(line_of, like_last, n_lines) / some_words,
        count["digit"] / some_characters,
        n_words,
        earlier,
        CLASSES["stop"][codes[last]],
    ]
    kinds = np.zeros(n_lines, np.int64)
    for value, steps in zip(values, STEPS.values()):
        kinds = kinds * (len(steps) + 1) + np.searchsorted(steps, value, "right")
    per_text = lambda c: np.add.reduceat(c, bounds[:-1], dtype=np.int64)
    sums = {
        "n_words": per_text(n_words),
        "word_chars": per_text(characters),
        "n_symbols": per_text(count["symbol"]),
        "n_dup_lines": per_text(earlier),
        "n_repeat_words": np.bincount(text_of, repeated, len(texts)).astype(np.int64),
    }
    return Measures(sums, np.where(n_words > 0, kinds, NO_WORD), n_words, bounds)


SUMS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, the sums of each row's ``text``, and its lines' kinds and words.

    A null text counts as empty: one line without words. A line without a word has no kind.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = measure(text_bytes(part.column("_text")))
                offsets = pa.array(found.bounds, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in (found.kinds, found.line_words)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(found.sums[c]) for c in SUMS), *lists], names=[*keep, *SUMS, "kinds", "line_words"]
                )

    rows = df.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}, {', '.join(f'{c} long' for c in SUMS)}, kinds array<int>, line_words array<int>")


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """Log-linear scores: of boilerplate over content for each kind of line, and of each label
    (0 content, 1 boilerplate) after each."""

    kinds: np.ndarray
    after: list[list[float]]

    def decode(self, kinds: np.ndarray) -> np.ndarray:
        """The labels of one text's lines with words that score highest; content where it ties."""
        if not len(kinds):
            return np.zeros(0, bool)
        (cc, cb), (bc, bb) = self.after
        scores = self.kinds[kinds].tolist()
        content, boilerplate, came = 0.0, scores[0], []
        for score in scores[1:]:
            a, b, c, d = content + cc, boilerplate + bc, content + cb, boilerplate + bb
            came.append((b > a, d > c))
            content, boilerplate = (b if b > a else a), (d if d > c else c) + score
        label = boilerplate > content
        labels = [label]
        for from_content, from_boilerplate in reversed(came):
            label = from_boilerplate if label else from_content
            labels.append(label)
        return np.array(labels[::-1])


#: Says content of every line; stands in where no line of either class is labelled.
NEUTRAL = Field(np.zeros(KINDS), [[0.0, 0.0], [0.0, 0.0]])


def _worded(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = np.asarray(column.values), np.asarray(column.offsets)
    for start, end in zip(offsets[:-1], offsets[1:]):
        own = values[start:end]
        yield own[own != NO_WORD]


def _contexts(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """Counts of (kind, label before, label after, label) over rows (kinds, good). ``marks`` tells the
    kinds that are boilerplate where a document is not good; 2 stands for no neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS * 18, np.int64)
        for batch in batches:
            for kinds, good in zip(_worded(batch.column("kinds")), batch.column("good").to_pylist()):
                if len(kinds):
                    labels = np.zeros(len(kinds), np.int64) if good else marks[kinds].astype(np.int64)
                    before, after = np.append(2, labels[:-1]), np.append(labels[1:], 2)
                    codes, counts = np.unique(((kinds * 3 + before) * 3 + after) * 2 + labels, return_counts=True)
                    total[codes] += counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["code", "n"])

    return rows.select("kinds", "good").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _design(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each context, and its label: one for each step but the first of each measure,
    a constant, neighbours that are boilerplate, a line before, a line after."""
    rest, label = np.divmod(codes, 2)
    rest, after = np.divmod(rest, 3)
    kinds, before = np.divmod(rest, 3)
    near = [(before == 1).astype(float) + (after == 1), (before != 2).astype(float), (after != 2).astype(float)]
    return np.column_stack([_kind_features(kinds), *near]), label


def _kind_features(kinds: np.ndarray) -> np.ndarray:
    columns, rest = [], kinds
    for size in reversed(SIZES):
        rest, step = np.divmod(rest, size)
        columns += [(step == s).astype(float) for s in range(1, size)]
    return np.column_stack([np.ones(len(kinds)), *columns])


def fit_counts(codes: np.ndarray, counts: np.ndarray, penalty: float = PENALTY, rounds: int = 100) -> Field:
    """The field that makes the counted contexts likeliest, less a penalty on squared weights."""
    x, y = _design(codes)
    weights = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(counts @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)) + w @ ridge @ w / 2)

    now = loss(weights)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        slope = x.T @ (counts * (p - y)) + ridge @ weights
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge, slope)
        # Newton's step, halved until it helps.
        size = 1.0
        while (then := loss(weights - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then <= 1e-9 * max(now, 1.0):
            break
        weights, now = weights - size * step, then
    alike, before, after = weights[-3:].tolist()
    # What a label adds behind and before each: after[0][1] = before, after[1][0] = after.
    return Field(_kind_features(np.arange(KINDS)) @ weights[:-3], [[0.0, before], [after, alike + before + after]])


def fit(rows: DataFrame, penalty: float = PENALTY) -> Field:
    """The field of labelled rows (kinds, good).

    All lines of good documents are content. A line of another document is boilerplate if its
    kind makes up more of the lines there than in good ones. No sample: every labelled row counts.
    """
    per_kind = rows.select("good", F.explode("kinds").alias("kind")).where(F.col("kind") != NO_WORD).groupBy("good", "kind").agg(F.count(F.lit(1)).alias("n"))
    number = {True: np.zeros(KINDS), False: np.zeros(KINDS)}
    for row in per_kind.collect():  # at most 2 * KINDS rows
        number[row["good"]][row["kind"]] = row["n"]
    if not number[True].any() or not number[False].any():
        return NEUTRAL
    marks = number[False] / number[False].sum() > number[True] / number[True].sum()
    found = np.array([(r["code"], r["n"]) for r in _contexts(rows, marks).collect()], np.int64)  # at most 18 * KINDS rows
    found = found[np.argsort(found[:, 0])]
    return fit_counts(found[:, 0], found[:, 1].astype(float), penalty)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, kinds) with ``good`` by ``labels`` (doc_id, quality 0 or 1). An id with null or
    differing qualities, or none, has no label; repeated rows all count."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    known = store(known.where("least = most").select("doc_id", (F.col("most") > 0).alias("good")), "labels")
    return lookup_join(rows.select("doc_id", "kinds"), known, ["doc_id"], ["kinds"], fits_broadcast(known)).where("good IS NOT NULL")


# ---------------------------------------------------------------- the verdict


def judged(rows: DataFrame, field: Field, keep: list[str], least_content: float = LEAST_CONTENT) -> DataFrame:
    """The kept columns of measured rows, ``content_share``, ``content`` and ``retained``.

    ``content`` lists runs of lines from ``first`` to before ``end`` whose lines with words are
    all content; lines count from 0. A text without words has share 0 and no run.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    run_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, contents = [], []
            kinds, words = batch.column("kinds"), batch.column("line_words")
            values, counts, offsets = np.asarray(kinds.values), np.asarray(words.values), np.asarray(kinds.offsets)
            starts = np.asarray(words.offsets)
            for start, end, words_start in zip(offsets[:-1], offsets[1:], starts[:-1]):
                number = np.flatnonzero(values[start:end] != NO_WORD)
                own = counts[words_start + number].astype(np.int64)
                content = ~field.decode(values[start + number])
                shares.append(float(own[content].sum() / own.sum()) if len(own) else 0.0)
                edges = np.diff(content.astype(np.int8), prepend=0, append=0)
                contents.append([{"first": a, "end": b + 1} for a, b in zip(number[edges[:-1] == 1].tolist(), number[edges[1:] == -1].tolist())])
            share = pa.array(shares, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), share, pa.array(contents, run_type), pa.array(np.array(shares) >= least_content)],
                names=[*keep, "content_share", "content", "retained"],
            )

    wanted = f"{schema}, content_share double, content array<struct<first: long, end: long>>, retained boolean"
    return rows.select(*keep, *(c for c in ("kinds", "line_words") if c not in keep)).mapInArrow(run, wanted)


def content_text(text, content):
    """A column of the lines of ``text`` in the runs ``content``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    kept = F.flatten(F.transform(content, lambda r: F.slice(lines, (r["first"] + 1).cast("int"), (r["end"] - r["first"]).cast("int"))))
    return F.array_join(kept, "\n")


def base_failed():
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))


def rule_documents(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, measures and verdict of each row of ``docs`` (doc_id, text, ...).

    ``kept`` is false where a base rule fails, else the field's verdict. A null or empty text has no
    words and fails. Repeated rows get equal results; very long texts are read whole; an empty
    table gives an empty result. Without labels of both classes nothing is boilerplate.
    """
    columns = list(dict.fromkeys(["doc_id", *keep]))
    rows = store(measured(docs, columns), "measured-lines")
    field = fit(labelled(rows, labels))
    verdicts = judged(rows, field, [*columns, *SUMS])
    return verdicts.select(*keep, *SUMS, base_failed().alias("base_failed"), (~base_failed() & F.col("retained")).alias("kept"), "content_share", "content")


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, by a field learned from ``labels``."""
    rows = rule_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return rows.drop("content")
