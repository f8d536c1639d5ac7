"""WARC archives of pages, with a two-level capture index.

Archives are gzip members, one per record, so each record is read by its range alone. The
index is sorted by URL keys with the host reversed (``org,example)/path``), cut into
compressed blocks of lines; each index file ends with a sparse directory of its blocks
(first key, offset, length). A lookup searches the files' key ranges, then the directory,
then one or a few blocks, and reads the records found by range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import open_folder, shared_folder, table
from trajloom.operators.store import store

MIN_REVISIT = 100
LEVEL = 5
BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URI = "urn:page:"
MAGIC = b"CAPTURES"
CAPTURE = "key string, page_id long, url string, record_type string, file string, offset long, length long"
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def url_key(url: str | None) -> str:
    """The sort key of a URL: reversed host, port if not the usual one, path and query.

    Scheme, user, fragment and a leading ``www`` are left out. A null or empty URL has the
    key ``-``.
    """
    if not url:
        return "-"
    found = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", url)
    scheme, host, port, rest = found.groups()
    parts = (host or "").lower().strip(".").split(".")
    if len(parts) > 1 and re.fullmatch(r"www\d*", parts[0]):
        parts = parts[1:]
    usual = {"http": "80", "https": "443"}.get((scheme or "http").lower())
    shown = f":{port}" if port and port != usual else ""
    rest = rest if rest.startswith("/") else f"/{rest}"
    return f"{','.join(reversed(parts))}{shown}){rest}"


# ---------------------------------------------------------------- records


def _line(value) -> str:
    """A header value: no line ends, whatever a URL holds."""
    return re.sub(r"[\r\n]+", " ", str(value))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, level: int = LEVEL) -> bytes:
    """One record; a revisit if ``first``, the page it repeats, is given."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <{PAGE_URI}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] * bool(url)
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if first is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URI}{first}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = zlib.decompress(packed, 31).partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return names, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def record_row(packed: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a response is checked."""
    names, http, payload = read_record(packed)
    digest, kind = names["WARC-Payload-Digest"].removeprefix("sha256:"), names["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError("a payload does not match its digest")
    ids = [names.get(n, "<>")[1:-1].removeprefix(PAGE_URI) for n in ("WARC-Record-ID", "WARC-Refers-To")]
    page_id, refers_to = (int(i) if i else None for i in ids)
    return page_id, int(http["Content-Length"]), digest, kind, refers_to


# ---------------------------------------------------------------- writing


def with_firsts(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Add payload, its size and digest, and ``first``: the smallest page_id with an equal
    payload, null for that page itself and for payloads below ``least`` bytes.

    Digests with one row alone are dropped before the join, so its small side holds the
    repeated payloads only; a very frequent one combines on the map side, and its rows are
    split by adaptive execution when joined.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    own = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(groups, "digest", "left").withColumn("first", own)


def write_archives(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Write all pages; returns the written list of captures (see CAPTURE), unsorted.

    Every attempt of a task writes files of its own names; only those of accepted attempts
    are listed.
    """
    folder = shared_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, file, at = None, None, 0
        for batch in batches:
            out = []
            for row in batch.select(["page_id", "url", "payload", "size", "digest", "first"]).to_pylist():
                if sink is None or at >= ARCHIVE_BYTES:
                    if sink is not None:
                        sink.close()
                    files, path = open_folder(folder)
                    files.create_dir(path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink, file = files.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"
                packed = record_bytes(*row.values())
                sink.write(packed)
                kind = "response" if row["first"] is None else "revisit"
                out.append((url_key(row["url"]), row["page_id"], row["url"], kind, file, at, len(packed)))
                at += len(packed)
            yield _captures(out)
        if sink is not None:
            sink.close()

    return store(with_firsts(pages, least).mapInArrow(write, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=FIELDS)


def write_index(captures: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key and write index files; returns (part, index, first_key,
    last_key, captures), one row per file.

    The sort breaks ties by page, file and offset, so one very frequent URL is spread over
    ranges as any other rows are.
    """
    folder = shared_folder(captures.sparkSession, "index")
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys are compared as Python compares strings: by code point, as Spark compares UTF-8.
    order = ["key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, directory, held, at, total, last = None, [], [], 0, 0, None

        def flush() -> None:
            nonlocal at, held
            packed = zlib.compress("\n".join(json.dumps(line) for line in held).encode(), 6)
            sink.write(packed)
            directory.append([held[0][0], at, len(packed)])
            at, held = at + len(packed), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in FIELDS)):
                if sink is None:
                    files, path = open_folder(folder)
                    files.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.idx"
                    sink = files.open_output_stream(f"{path}/{name}", compression=None)
                held.append(row)
                total, last = total + 1, row[0]
                if len(held) >= lines:
                    flush()
        if sink is not None:
            if held:
                flush()
            packed = zlib.compress(json.dumps(directory).encode())
            sink.write(packed + struct.pack("<QQ", at, len(packed)) + MAGIC)
            sink.close()
            columns = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [directory[0][0]], [last], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "index", "first_key", "last_key", "captures"])

    schema = "part int, index string, first_key string, last_key string, captures long"
    cast = lambda b: pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *b.columns[1:]], names=b.schema.names)
    return store(ordered.mapInArrow(lambda batches: map(cast, write(batches)), schema), "index")


# ---------------------------------------------------------------- reading


class IndexFile:
    """One index file: its directory, and blocks read by range when a key asks for them."""

    def __init__(self, uri: str):
        files, path = open_folder(uri)
        self.source = files.open_input_file(path)
        size = self.source.size()
        at, length, magic = struct.unpack("<QQ8s", self._range(size - 24, 24))
        if magic != MAGIC:
            raise ValueError("no capture index")
        self.directory = json.loads(zlib.decompress(self._range(at, length)))
        self.keys = [entry[0] for entry in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def _range(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def block(self, i: int) -> list[list]:
        if self.held[0] != i:
            _, at, length = self.directory[i]
            self.held = (i, [json.loads(line) for line in zlib.decompress(self._range(at, length)).split(b"\n")])
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key, in order: binary search in the directory, then in a block."""
        i = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while i < len(self.keys) and self.keys[i] <= key:
            lines = self.block(i)
            for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
                if line[0] != key:
                    return
                yield line
            i += 1

    def close(self) -> None:
        self.source.close()


def find_captures(keys: DataFrame, index: DataFrame) -> DataFrame:
    """The captures (see CAPTURE) of every distinct key of the column ``key``.

    Keys are sent to the index files whose key range holds them, found by binary search in
    the list of ranges, which has one entry per index file. A key with captures in several
    files goes to each of them.
    """
    ranges = index.orderBy("part").select("index", "first_key", "last_key").collect()
    files, firsts, lasts = ([r[c] for r in ranges] for c in ("index", "first_key", "last_key"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(files[i], k) for k in batch.column("key").to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["index", "key"])

    wanted = keys.select("key").where(F.col("key").isNotNull()).distinct()
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = wanted.mapInArrow(place, "index string, key string")
    placed = placed.repartition(partitions, "index").sortWithinPartitions("index", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, uri = None, None
        for batch in batches:
            out = []
            for wanted_in, key in zip(batch.column("index").to_pylist(), batch.column("key").to_pylist()):
                if wanted_in != uri:
                    if file is not None:
                        file.close()
                    file, uri = IndexFile(wanted_in), wanted_in
                for line in file.find(key):
                    out.append(tuple(line))
                    if len(out) >= 10_000:
                        yield _captures(out)
                        out = []
            yield _captures(out)
        if file is not None:
            file.close()

    return placed.mapInArrow(search, CAPTURE)


def read_captures(captures: DataFrame) -> DataFrame:
    """The records of captures, see RECORD, each read by its range.

    Captures are sorted by file and offset first, so that a task reads forwards through a few
    archives.
    """
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.select("file", "offset", "length").repartitionByRange(partitions, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, uri = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != uri:
                    if source is not None:
                        source.close()
                    files, path = open_folder(file)
                    source, uri = files.open_input_file(path), file
                source.seek(offset)
                out.append(record_row(source.read(length)))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RECORD_TYPES)], names=[f.split()[0] for f in RECORD.split(", ")])
        if source is not None:
            source.close()

    return placed.mapInArrow(read, RECORD)


def lookup(index: DataFrame, url: str) -> list[tuple]:
    """The records of one URL, read on the driver: see RECORD."""
    key, found = url_key(url), []
    for row in index.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part").toLocalIterator():
        file = IndexFile(row["index"])
        for line in file.find(key):
            files, path = open_folder(line[4])
            with files.open_input_file(path) as source:
                source.seek(line[5])
                found.append(record_row(source.read(line[6])))
        file.close()
    return found


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as written, found through the index, and read back.

    A null html is an empty payload. Rows that tie in the smallest page_id of a payload are
    each a response; a row without page_id revisits a page that has one, and is a response if
    there is none. An empty table gives an empty result.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captures = write_archives(pages)
    index = write_index(captures)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    asked = pages.select("url").mapInArrow(keys, "key string")
    return read_captures(find_captures(asked, index))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
