"""What several operators share: words as hashes, running sums, shared files, tokenizers.

Words, unless an operator says otherwise, are the runs of ASCII digits and letters and of
all characters beyond ASCII, after A-Z is put in lower case. On UTF-8 bytes that is a
property of each byte, so whole batches of texts are cut and hashed as one byte array.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.operators.store import new_path, store

#: A batch of texts is worked on in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
#: The same for work that holds many numbers a word.
WORDS_BYTES = PIECE_BYTES // 4
#: Spark hands rows to Python in batches of about so many bytes, see :func:`bounded_batches`.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to all batches; a result in ``schema``'s order."""
    wanted = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, wanted)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs that run inside: batches for Python are bounded by their bytes, not by 10 000 rows
    alone, which takes as much memory as those rows are long. A limit that the session has stays."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def store_by_batches(df: DataFrame, name: str) -> DataFrame:
    """:func:`store` for tables that Python makes from long rows."""
    with bounded_batches(df.sparkSession):
        return store(df, name)


def slices(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes together."""
    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.diff(np.frombuffer(texts.buffers()[1], _offset_type(texts), len(texts) + 1 + texts.offset)[texts.offset :])
    piece = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, end - start)


def _offset_type(texts: pa.Array):
    return np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [t or b"" for t in texts.cast(pa.large_binary() if _offset_type(texts) is np.int64 else pa.binary()).to_pylist()]


# ---------------------------------------------------------------- words


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8)
    is_word = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | (codes >= 128)
    return lower, is_word[lower]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result hangs on every bit of ``x``."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER, IS_WORD = _tables()
#: Longer words are hashed one by one.
LONG_WORD = 256


def word_parts(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of byte strings in a buffer: the k-th 8 bytes of those that have any, zeros behind their
    end, and which strings these are; for k = 0, 1, ..."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))
    some, at = np.flatnonzero(sizes > 0), 0
    while len(some):
        left = np.minimum(sizes[some] - at, 8).astype(np.uint64)
        yield some, words[starts[some] + at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        at += 8
        some = some[sizes[some] > at]


def hashed(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings in a buffer: each 8 bytes are mixed into what came before."""
    out = mix(sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > LONG_WORD)
    for some, part in word_parts(buffer, starts, np.where(sizes > LONG_WORD, 0, sizes)):
        out[some] = mix(out[some] ^ part)
    for i in long.tolist():
        digest = hashlib.blake2b(buffer[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8)
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a byte array."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = IS_WORD[buffer]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word; memory beyond the result is bounded."""
    starts, hashes, at = [], [], 0
    while at < len(buffer):
        end = min(at + PIECE_BYTES, len(buffer))
        if end < len(buffer):
            # Cut between words, so that a word is hashed whole.
            gaps = np.flatnonzero(~IS_WORD[buffer[at:end]])
            while not len(gaps) and end < len(buffer):
                end = min(end + PIECE_BYTES, len(buffer))
                gaps = np.flatnonzero(~IS_WORD[buffer[at:end]])
            if end < len(buffer):
                end = at + int(gaps[-1]) + 1
        piece = buffer[at:end]
        first, last = word_spans(piece)
        hashes.append(hashed(LOWER[piece], first, last - first))
        starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the index of the first word of each text (and the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buffer = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    starts, hashes = word_hashes(buffer)
    bounds = np.zeros(len(texts) + 1, np.int64)
    bounds[1:] = np.searchsorted(starts, np.cumsum(lengths))
    return hashes, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words, and the first of each text (and the end).

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    full = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    number = full + short
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(number, out=out_bounds[1:])
    out = np.zeros(out_bounds[-1], np.uint64)
    if len(words) >= size:
        runs = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            runs = mix(runs) + words[k : len(words) - size + 1 + k]
        text = np.repeat(np.arange(len(full)), full)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(full) - full, full)
        out[out_bounds[text] + inside] = runs[bounds[text] + inside]
    for i in np.flatnonzero(short).tolist():
        run = words[bounds[i] : bounds[i] + 1]
        for k in range(bounds[i] + 1, bounds[i + 1]):
            run = mix(run) + words[k : k + 1]
        out[out_bounds[i]] = mix(run + np.uint64(counts[i]))[0]
    return mix(out), out_bounds


def words_column(text: Column) -> Column:
    """The words of a text as an array of strings, in SQL functions."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


# ---------------------------------------------------------------- order


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], partitions: int | None = None, name: str = "sums") -> DataFrame:
    """Add for each (new column: size column) the sum over all rows before, in a global order.

    Rows are placed by range, so no task gets more than its share even if all keys are
    equal but for a tie-break. Sums inside a range are made while it is written; the short
    list of range totals is summed up in one task and joined back. ``order`` should be
    unique: between full ties the order is open.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), *(T.StructField(c, T.LongType()) for c in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64))]
            for new, size in sums.items():
                sizes = np.asarray(batch.column(size).fill_null(0)).astype(np.int64)
                ends = before[new] + np.cumsum(sizes)
                columns.append(pa.array(ends - sizes))
                before[new] = int(ends[-1]) if len(ends) else before[new]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    stored = store_by_batches(ranged.mapInArrow(run, schema), name)
    totals = stored.groupBy("_part").agg(*(F.sum(size).alias(f"_{new}") for new, size in sums.items()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in sums))
    joined = stored.join(F.broadcast(offsets), "_part")
    return joined.withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums}).drop("_part", *(f"_{new}" for new in sums))


def tagged(df: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """The rows, written with a number each that is the same at every reading."""
    return store_by_batches(df.withColumn(row, F.monotonically_increasing_id()), name)


# ---------------------------------------------------------------- shared files


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a URI that the tasks open."""
    path = new_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def open_folder(uri: str):
    """File system and path of a URI; whatever pyarrow can open: local, HDFS, S3, GCS."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- tokenizers


#: ASCII letters and digits.
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: A text of more characters is encoded in parts.
LONG_TEXT = 2_000_000
#: ASCII white space.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def _wide_spaces(buffer: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins in UTF-8."""
    leads = np.flatnonzero((buffer == 0xC2) | (buffer == 0xE1) | (buffer == 0xE2) | (buffer == 0xE3))
    if not len(leads):
        return leads
    code, second, third = (buffer[np.minimum(leads + k, len(buffer) - 1)].astype(np.int64) for k in range(3))
    point = np.where(code == 0xC2, second, ((code & 15) << 12) | ((second & 63) << 6) | (third & 63))
    wide = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    return leads[np.isin(point, wide)]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class WordMemory:
    """Byte strings of at most LONG_WORD bytes, each with a mark, and the token ids of each.

    An open-addressing table by hash; whatever is found is compared byte by byte. All arrays
    have fixed sizes, which the system hands out as they fill; when one is full, all is forgotten.
    """

    def __init__(self, words: int):
        self.words = words
        self.clear()

    def clear(self) -> None:
        slots = 1 << max(2 * self.words - 1, 1).bit_length()
        self.mask = np.uint64(slots - 1)
        self.slots = np.zeros(slots, np.int32)  # number of a string, from 1
        self.hashes, self.marks = np.zeros(self.words, np.uint64), np.zeros(self.words, np.int32)
        self.ids_at, self.ids_size = np.zeros(self.words, np.int64), np.zeros(self.words, np.int32)
        self.bank_at = np.zeros(self.words, np.int64)
        self.ids, self.bank = np.zeros(8 * self.words, np.uint32), np.zeros(4 * self.words, np.uint64)
        self.count = self.ids_used = self.bank_used = 0

    def fits(self, sizes: np.ndarray, ids: int) -> bool:
        parts = int(((sizes + 7) >> 3).sum())
        return self.count + len(sizes) <= self.words and self.ids_used + ids <= len(self.ids) and self.bank_used + parts <= len(self.bank)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the string with each hash, from 0; -1 if there is none."""
        found = np.full(len(hashes), -1, np.int64)
        pending, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(pending):
            entry = self.slots[at].astype(np.int64) - 1
            hit = (entry >= 0) & (self.hashes[entry] == hashes[pending])
            found[pending[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            pending, at = pending[on], (at[on] + 1) & int(self.mask)
        return found

    def equal(self, entries: np.ndarray, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Whether each string is the one with the number told; -1 is none."""
        same = (entries >= 0) & (self.marks[entries] == (sizes << 1) + marks)
        at = self.bank_at[entries]
        for k, (some, part) in enumerate(word_parts(buffer, starts, np.where(same, sizes, 0))):
            same[some] &= self.bank[at[some] + k] == part
        return same

    def add(self, hashes: np.ndarray, ids: np.ndarray, numbers: np.ndarray, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> None:
        """Strings of distinct hashes that are not known, and the ids of all, ``numbers`` of them each."""
        own = slice(self.count, self.count + len(hashes))
        parts = (sizes + 7) >> 3
        self.hashes[own], self.marks[own], self.ids_size[own] = hashes, (sizes << 1) + marks, numbers
        self.ids_at[own] = self.ids_used + np.cumsum(numbers) - numbers
        self.bank_at[own] = at = self.bank_used + np.cumsum(parts) - parts
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        for k, (some, part) in enumerate(word_parts(buffer, starts, sizes)):
            self.bank[at[some] + k] = part
        pending, slot = np.arange(self.count, self.count + len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(pending):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = pending[free] + 1
            on = self.slots[slot] != pending + 1
            pending, slot = pending[on], (slot[on] + 1) & int(self.mask)
        self.count, self.ids_used, self.bank_used = self.count + len(hashes), self.ids_used + len(ids), self.bank_used + int(parts.sum())


class CachedEncoder:
    """Encode texts as the tokenizer file does, word by word with a memory of words.

    ``kind`` tells where a text may be cut without changing ids: a byte-level vocabulary that
    keeps a space with the word after it (``spaced``), or one that drops white space and case
    (``dropped``). Words end at spaces and line ends, and before a full stop or comma that
    ends them. A text that has other white space, or two white spaces in a row, is encoded
    whole in the first kind. New words are encoded many at a time, with a word between them
    whose id is known. ``words`` bounds the memory, about 90 bytes each.
    """

    def __init__(self, path: str, kind: str, end_id: int, words: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.end_id = {"spaced": True, "dropped": False}[kind], end_id
        self.between = "\n" if self.spaced else " | "
        (self.between_id,) = self._ids(self.between)
        # Words in which the divider, white space or a special token may hide go alone.
        self.odd = np.isin(np.arange(256), [*range(32), 60, 127] + [124] * (not self.spaced))
        self.memory = WordMemory(words)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, buffer: np.ndarray, first: np.ndarray, size: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and their numbers; words that hide nothing, with their leading space."""
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # All words with the divider behind each, as one byte string.
        divider = np.frombuffer(self.between.encode(), np.uint8)
        whole = led + size + len(divider)
        stops = np.cumsum(whole)
        text = np.full(int(stops[-1]), 32, np.uint8)
        text[np.repeat(stops - len(divider) - size, size) + _counting(size)] = buffer[np.repeat(first, size) + _counting(size)]
        for k, code in enumerate(divider.tolist()):
            text[stops - len(divider) + k] = code
        raw, lines = text.tobytes(), [*range(0, len(first), TOGETHER), len(first)]
        cuts = [0, *stops[np.array(lines[1:]) - 1].tolist()]
        texts = [raw[a : b - len(divider)].decode() for a, b in zip(cuts, cuts[1:])]
        found = []
        for at in range(0, len(texts), 100):
            for encoding in self.tokenizer.encode_batch_fast(texts[at : at + 100], add_special_tokens=False):
                found += encoding.ids
                found.append(self.between_id)
        ids = np.array(found, np.uint32)
        ends = np.flatnonzero(ids == self.between_id)
        if len(ends) != len(first):
            raise ValueError("the divider of words is not a word of its own in this vocabulary")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _whole(self, coded: list[bytes]) -> np.ndarray:
        """Whether each text can't be cut at words."""
        if not self.spaced or not coded:
            return np.zeros(len(coded), bool)
        buffer = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        space = _SPACE[buffer]
        odd = np.append(np.flatnonzero(space[1:] & space[:-1]), _wide_spaces(buffer))
        starts = np.cumsum([0, *(len(c) + 1 for c in coded[:-1])])
        found = np.array([c.endswith(b" ") for c in coded])
        found[np.searchsorted(starts, odd, "right") - 1] = True
        return found

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, with the end id, of each text."""
        end = np.array([self.end_id], "<u4").tobytes()
        out: list[bytes] = [end] * len(texts)
        some = [i for i, text in enumerate(texts) if text]
        coded = [texts[i].encode() for i in some]
        cut: list[int] = []
        held: list[bytes] = []
        for i, raw, whole in zip(some, coded, self._whole(coded).tolist()):
            if whole:
                out[i] = np.array(self._ids(texts[i]), "<u4").tobytes() + end
            elif len(raw) > LONG_TEXT:
                out[i] = b"".join(self._cut([part])[0][: -len(end)] for part in self._parts(raw)) + end
            else:
                cut.append(i)
                held.append(raw)
        for i, ids in zip(cut, self._cut(held) if cut else ()):
            out[i] = ids
        return out

    def _parts(self, text: bytes) -> Iterator[bytes]:
        """A long text, cut before spaces."""
        at = 0
        while at < len(text):
            end = text.rfind(b" ", at + 1, at + LONG_TEXT) if at + LONG_TEXT < len(text) else len(text)
            end = text.find(b" ", at + 1) if end < 0 else end
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def _cut(self, coded: list[bytes]) -> list[bytes]:
        raw = b"\n".join(coded) + b"\n"
        buffer = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(c) + 1 for c in coded]) - 1
        gap = (buffer == 32) | (buffer == 10)
        # A full stop or comma between a letter or digit and a gap is a word of its own.
        mark = np.zeros(len(buffer), bool)
        mark[1:-1] = ((buffer[1:-1] == 46) | (buffer[1:-1] == 44)) & _ALNUM[buffer[:-2]] & gap[2:]
        first = ~gap
        first[1:] &= gap[:-1] | mark[1:]
        last = ~gap
        last[:-1] &= gap[1:] | mark[1:]
        first, size = np.flatnonzero(first), np.flatnonzero(last) + 1
        size -= first
        led = np.zeros(len(first), np.int64)
        if self.spaced:
            led[first > 0] = buffer[first[first > 0] - 1] == 32
        else:
            buffer = LOWER[buffer]
        hashes = mix(hashed(buffer, first, np.where(size > LONG_WORD, 0, size)) ^ led.astype(np.uint64))
        entry, alone = self._entries(raw, buffer, first, size, led, hashes)
        number = np.where(entry >= 0, self.memory.ids_size[entry], 0).astype(np.int64)
        for i, own in alone.items():
            number[i] = len(own)
        # Words, line ends that are tokens, and ends of texts, in the order of the text.
        extra = np.flatnonzero(buffer == 10) if self.spaced else ends
        is_end = np.zeros(len(buffer), bool)
        is_end[ends] = True
        at = np.searchsorted(first, extra)
        places = np.insert(np.where(entry >= 0, self.memory.ids_at[entry], 0), at, np.where(is_end[extra], -2, -1))
        sizes = np.insert(number, at, 1)
        starts = np.cumsum(sizes) - sizes
        where = np.repeat(np.maximum(places, 0) - starts, sizes)
        where += np.arange(len(where))
        ids = np.take(self.memory.ids, where, mode="clip")
        ids[starts[places == -1]] = self.between_id
        stops = starts[places == -2]
        ids[stops] = self.end_id
        for i, own in alone.items():
            start = starts[i + int(np.searchsorted(at, i, "right"))]
            ids[start : start + len(own)] = own
        whole, cuts = ids.astype("<u4").tobytes(), [0, *(4 * stops + 4).tolist()]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def _entries(self, raw: bytes, buffer: np.ndarray, first: np.ndarray, size: np.ndarray, led: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Number of each word in the memory, and the ids of words that it does not keep: those
        that are long, that hide something, or whose hash another word has."""
        hides = self.odd[buffer]
        hides[_wide_spaces(buffer)] = True
        hides = np.concatenate([[0], np.cumsum(hides)])
        single = (size > LONG_WORD) | (hides[first + size] > hides[first])

        def word(i: int) -> str:
            return (" " if led[i] else "") + raw[first[i] : first[i] + size[i]].decode()

        def known() -> np.ndarray:
            found = np.where(single, -1, self.memory.find(hashes))
            return np.where(self.memory.equal(found, buffer, first, size, led), found, -1)

        entry = known()
        new = np.flatnonzero((entry < 0) & ~single)
        if len(new):
            new = new[np.unique(hashes[new], return_index=True)[1]]
            new = new[self.memory.find(hashes[new]) < 0]
            ids, numbers = self._learn(buffer, first[new], size[new], led[new])
            if not self.memory.fits(size[new], len(ids)):
                # Forget all; of this batch every word is new again.
                self.memory.clear()
                new = np.flatnonzero(~single)
                new = new[np.unique(hashes[new], return_index=True)[1]]
                ids, numbers = self._learn(buffer, first[new], size[new], led[new])
            if self.memory.fits(size[new], len(ids)):
                self.memory.add(hashes[new], ids, numbers, buffer, first[new], size[new], led[new])
            entry = known()
        alone, once = {}, {}
        for i in np.flatnonzero(entry < 0).tolist():
            text = word(i)
            if text not in once:
                once[text] = self._ids(text)
            alone[i] = once[text]
        return entry, alone


#: So many new words make a text of their own.
TOGETHER = 100
_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, kind: str, end_id: int) -> CachedEncoder:
    """One encoder for all tasks of a Python worker."""
    key = (path, kind, end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(*key)
    return _ENCODERS[key]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
