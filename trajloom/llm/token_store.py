"""Token ids as files of independent zstandard frames with a seek table.

A file is, from its start: one zstandard frame per document with its ids as little-endian
integers of 2 or 4 bytes; a skippable frame with the documents' ids and, for each, whether
it has one; and a skippable frame
with the seek table of the public zstandard seekable format (compressed size, size and
checksum of each frame; the checksum is the low half of XXH64 of the ids). Any zstandard
tool unpacks such a file; a reader that wants one document reads the table at the end and
then only that document's bytes.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajloom.llm.common import crc32, encoder, open_folder, shared_folder, slices, table
from trajloom.operators.store import store

# Fixed values of the zstandard formats: skippable frames and the seek table.
SKIPPABLE_TABLE, SKIPPABLE_OWN, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
LEVEL = 3
MANIFEST = "part long, file string, width int, documents long, tokens long, bytes long, least_id long, most_id long"


class TokenFileWriter:
    """Append documents, then :meth:`close` writes the tables."""

    def __init__(self, sink, width: int = 2, level: int = LEVEL):
        self.sink, self.width = sink, width
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.entries, self.ids, self.tokens, self.bytes = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.pack.compress(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.tokens, self.bytes = self.tokens + len(ids), self.bytes + len(frame)

    def close(self) -> None:
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is not None for i in self.ids)
        ids = struct.pack("<BQ", self.width, len(self.ids)) + ids
        self.sink.write(struct.pack("<II", SKIPPABLE_OWN, len(ids)) + ids)
        body = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        body += struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)
        self.sink.close()


class TokenFile:
    """Read documents by number or id from a seekable source of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = size - 9 - 12 * n - 8 - 9 * n - 9
        self.width, count = struct.unpack("<BQ", self._at(at, 9))
        if count != n:
            raise ValueError("the tables of the file disagree")
        self.doc_ids = np.frombuffer(self._at(at + 9, 8 * n), "<i8")
        self.has_id = np.frombuffer(self._at(at + 9 + 8 * n, n), bool)
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; only its frame is read, and checked."""
        size, raw_size, checksum = (int(x) for x in self.table[i])
        raw = self.unpack.decompress(self._at(int(self.starts[i]), size), max_output_size=max(raw_size, 1))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Numbers of the documents with an id."""
        return np.flatnonzero((self.doc_ids == doc_id) & self.has_id).tolist()


def write_token_files(df: DataFrame, tokenizer: str, kind: str, end_id: int, width: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode and write ``df`` (doc_id, text) in ascending doc_id order, a file per range.

    Returns the written manifest: part, file, width, documents, tokens, bytes, and the smallest
    and largest id, null if no document has one. Rows of equal ids go by a digest of
    their texts, so that no text is a sort key. Each attempt
    of a task writes a file of its own name and only attempts that Spark accepts are in the
    manifest, so lost executors and repeated tasks do no harm. ``width`` is 2 for
    vocabularies below 65 536 ids, else 4.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "tokens")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_digest").asc_nulls_first()]
    rows = df.select("doc_id", "text", F.md5("text").alias("_digest")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, name = TaskContext.get().partitionId(), None, f"{uuid.uuid4().hex}.zst"
        encode = encoder(tokenizer, kind, end_id).encode_many
        for batch in batches:
            for rows_in in slices(batch, "text"):
                if writer is None:
                    files, path = open_folder(folder)
                    files.create_dir(path, recursive=True)
                    writer = TokenFileWriter(files.open_output_stream(f"{path}/{name}", compression=None), width)
                for doc_id, ids in zip(rows_in.column("doc_id").to_pylist(), encode(rows_in.column("text").to_pylist())):
                    writer.add(doc_id, np.frombuffer(ids, "<u4"))
        if writer is not None:
            writer.close()
            known = [i for i in writer.ids if i is not None]
            row = [[part], [f"{folder}/{name}"], [width], [len(writer.entries)], [writer.tokens], [writer.bytes], [min(known, default=None)], [max(known, default=None)]]
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return store(rows.mapInArrow(write, MANIFEST), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, file, frame.

    ``start`` counts the ids of all documents before, over all files. A task reads one file
    after the other, a frame at a time; checksums are checked.
    """
    spark = manifest.sparkSession
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = manifest.select("part", "file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                system, path = open_folder(file)
                with system.open_input_file(path) as source:
                    tokens = TokenFile(source, source.size())
                    out = np.zeros((3, len(tokens)), np.int64)
                    for i in range(len(tokens)):
                        ids = tokens.ids(i)
                        out[:, i] = start, len(ids), crc32(ids.astype("<u4").tobytes())
                        start += len(ids)
                    doc_ids = pa.array(tokens.doc_ids, mask=~tokens.has_id)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, *map(pa.array, out), pa.array([file] * len(tokens)), pa.array(np.arange(len(tokens)))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "frame"],
                    )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long")


def fetch(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents, read on the driver from their frames alone; only files whose
    ids may hold one of them are opened."""
    found: dict[int, list[np.ndarray]] = {}
    wanted = reduce(or_, [F.lit(doc_id).between(F.col("least_id"), F.col("most_id")) for doc_id in doc_ids], F.lit(False))
    for row in manifest.where(wanted).toLocalIterator():
        system, path = open_folder(row.file)
        with system.open_input_file(path) as source:
            tokens = TokenFile(source, source.size())
            for doc_id in doc_ids:
                for i in tokens.find(doc_id):
                    found.setdefault(doc_id, []).append(tokens.ids(i))
    return found


def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written and read back; a null text is empty and has the end id alone.

    Rows with equal ids follow digests of their texts, null ids come first. An empty table gives an
    empty result; further columns are not read.
    """
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_files(table(spark, sf_dir, "documents"), path, "dropped", end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
