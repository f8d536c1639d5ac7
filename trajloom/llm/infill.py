"""Fill-in-middle: texts cut at two unit borders and written in another order.

The borders between a text's lines are a set of byte offsets, kept as the compressed bitmaps of
Roaring sets keep theirs: the upper bits choose a container of 65536 offsets, which is a sorted
array, a bitmap or a list of runs, whichever is smallest, and cumulative cardinalities lead to
the container that holds the k-th border. Both cuts of a text are such selections, so a
text of millions of lines takes little memory and its cuts no walk over its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import slices, table, text_bytes

SEED = 7
#: Per cent of texts that are rewritten, and of those the per cent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
CONTAINER = 1 << 16


class ArrayContainer:
    """Sorted values of 16 bits."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return 2 * len(values)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """A bit for each of the 65536 values, and the number of bits before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return CONTAINER // 8

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        left, bits = k - int(self.before[word]), int(self.words[word])
        for _ in range(left):
            bits &= bits - 1  # the lowest bit goes
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    """First value of each run of consecutive values, and the number of values before it."""

    def __init__(self, values: np.ndarray):
        first = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        self.starts, self.before = values[first].astype(np.uint16), first.astype(np.uint32)

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return 4 * runs

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BoundarySet:
    """A set of offsets, given in ascending order, that tells its k-th member."""

    def __init__(self, offsets: np.ndarray):
        upper = offsets >> 16
        first = np.flatnonzero(np.diff(upper, prepend=-1))
        self.upper, self.containers = upper[first], []
        self.before = np.append(first, len(offsets))
        for start, end in zip(self.before[:-1].tolist(), self.before[1:].tolist()):
            values = offsets[start:end] & (CONTAINER - 1)
            runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
            kind = min((ArrayContainer, RunContainer, BitmapContainer), key=lambda c: c.size(values, runs))
            self.containers.append(kind(values))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.upper[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def line_ends(text: bytes) -> np.ndarray:
    """Offset behind each line; a line ends behind its line feed, the last one at the text's end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits from a seed and a row's key; a null key is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def characters(part: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(part.decode())


def cut(text: bytes, ends: np.ndarray, numbers: list[int], rate: int, suffix_first: int) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the rewritten text."""
    if not text or any(m in text for m in MARKERS) or numbers[2] % 100 >= rate:
        return "plain", None, None, text
    units = BoundarySet(ends)
    first, last = sorted(n % (len(units) + 1) for n in numbers[:2])
    start, end = (units.select(k - 1) if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    marked = {m: m.encode() + part for m, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if numbers[3] % 100 < suffix_first else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return form, characters(prefix), characters(middle), b"".join(marked[m] for m in order)


def fill_in_middle(df: DataFrame, key: str, keep: list[str], seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The kept columns, and n, form, prefix_chars, middle_chars and ``output`` of each ``text``.

    Units are lines with their line feed. The prefix ends behind one number of units and the
    middle behind another, both drawn by the row's ``key``, so rows of equal key and text get
    equal results. A text that is empty or null (then empty), holds a marker, or is not
    drawn stays as it is, with form ``plain`` and null lengths.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    results = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = []
                for row_key, text in zip(part.column("_key").to_pylist(), text_bytes(part.column("_text"))):
                    ends = line_ends(text)
                    form, prefix, middle, output = cut(text, ends, draws(seed, row_key), rate, suffix_first)
                    found.append((len(ends), form, prefix, middle, output))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), results)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, *results.names])

    rows = df.select(*keep, F.col(key).alias("_key"), F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; no cut part holds a marker, so markers part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def infill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: checksums of the rewritten text and of the one restored from it."""
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
