"""``spark.read.format("trajectories")`` and its stream: file lists, markers and splits by name.

The rules are those of :mod:`trajloom.sources.reader`; there Spark's own scans read the files,
which prunes columns and is the faster way for large tables. This source is for callers that
know a format's name only: SQL, notebooks, streams over a growing dataset directory.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.json as pj
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

import trajloom
from trajloom.sources.reader import NAME_FORMAT, SEPARATOR, SIDE_FILES, SPLIT_WORD, SPLIT_WORDS, TEST, TRAIN, file_format

cloudpickle.register_pickle_by_value(trajloom)

SPLIT = "split"
#: Bytes of a file that one task reads, unless the option ``partitionBytes`` says otherwise.
PARTITION_BYTES = 128 * 1024 * 1024
#: Bytes of JSON lines that are parsed at once; a longer line is read whole.
BLOCK_BYTES = 8 * 1024 * 1024


@dataclass
class Piece(InputPartition):
    """A range of bytes of a file."""

    path: str
    kind: str
    split: str
    start: int
    end: int
    size: int

    def __hash__(self) -> int:
        return hash((self.path, self.start))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme, or with ``file:``, is local; others are what pyarrow opens."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def visible_files(path: str) -> Iterator[tuple[fs.FileInfo, str]]:
    """Files at or below a path with their names below it, hidden ones left out, in order of name."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        yield info, info.base_name
    elif info.type == fs.FileType.Directory:
        for found in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            below = found.path[len(root.rstrip("/")) :].lstrip("/")
            hidden = any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in below.split("/"))
            if found.type == fs.FileType.File and not hidden:
                yield found, below
    else:
        raise FileNotFoundError(path)


def split_of(below: str) -> str | None:
    word = re.search(SPLIT_WORD, "/" + unquote(below))
    return next((name for name, words in SPLIT_WORDS.items() if word and word.group(1) in words), None)


def found_files(path: str, partial: bool = False) -> list[Piece]:
    """Each file as one piece: of a ``||`` list all as training rows, of a directory by split.

    ``partial`` takes a directory as it is, also without any file yet or any training file.
    """
    paths = path.split(SEPARATOR)
    kinds = {file_format(p) for p in paths}
    if len(kinds) > 1:
        raise ValueError(f"one file list must have one format: {path}")
    (kind,) = kinds
    if kind is not None:
        return [Piece(f.path, kind, TRAIN, 0, f.size, f.size) for p in paths for f, _ in visible_files(p)]
    files = []
    for info, below in visible_files(path):
        marker = re.search(NAME_FORMAT, info.base_name.lower())
        if marker and info.base_name.lower() not in SIDE_FILES:
            files.append(Piece(info.path, marker.group(1), split_of(below), 0, info.size, info.size))
    if partial:
        return [f for f in files if f.split in (TRAIN, TEST)]
    if len({f.kind for f in files}) != 1:
        raise ValueError(f"{path} must hold JSON or parquet files, and of one kind")
    if all(f.split is None for f in files):
        return [Piece(f.path, f.kind, TRAIN, 0, f.size, f.size) for f in files]
    if TRAIN not in {f.split for f in files}:
        raise ValueError(f"no training files in {path}")
    return [f for f in files if f.split in (TRAIN, TEST)]


def chosen(files: list[Piece], splits: str | None) -> list[Piece]:
    """The files of the named splits (``train,test``), or all."""
    names = None if splits is None else {name.strip() for name in splits.split(",")}
    if names is not None and not names <= {TRAIN, TEST}:
        raise ValueError(f"the splits are {TRAIN} and {TEST}, not {splits}")
    return [f for f in files if names is None or f.split in names]


def pieces(files: list[Piece], size: int) -> list[Piece]:
    return [
        Piece(f.path, f.kind, f.split, at, min(at + size, f.size), f.size)
        for f in files
        for at in range(0, f.size, size)
    ]


def parquet_batches(file, piece: Piece) -> Iterator[pa.RecordBatch]:
    """Batches of the row groups whose middle lies in the piece; each has one such piece."""
    reader = pq.ParquetFile(file)

    def middle(i: int) -> int:
        group = reader.metadata.row_group(i)
        columns = [group.column(c) for c in range(group.num_columns)]
        starts = [c.dictionary_page_offset or c.data_page_offset for c in columns]
        return min(starts) + sum(c.total_compressed_size for c in columns) // 2

    groups = [i for i in range(reader.num_row_groups) if piece.start <= middle(i) < piece.end]
    if groups:
        yield from reader.iter_batches(row_groups=groups)


def json_lines(file, piece: Piece) -> Iterator[bytes]:
    """Blocks of whole lines that begin in the piece; a line belongs to where it begins."""
    file.seek(max(piece.start - 1, 0))
    lines = io.BufferedReader(file, 1 << 20)
    if piece.start:
        lines.readline()
    block, size = [], 0
    while lines.tell() < piece.end and (line := lines.readline()):
        block.append(line)
        size += len(line)
        if size >= BLOCK_BYTES:
            yield b"".join(block)
            block, size = [], 0
    if block:
        yield b"".join(block)


def starts_array(file) -> bool:
    file.seek(0)
    while head := file.read(4096):
        if head := head.lstrip():
            return head[:1] == b"["
    return False


def json_batches(file, piece: Piece, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of JSON lines, or of a file that is one JSON array, which one task reads whole."""
    if starts_array(file):
        if piece.start == 0:
            file.seek(0)
            rows = iter(json.loads(file.read()))
            while part := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_pylist(part, schema=schema)
        return
    options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
    for block in json_lines(file, piece):
        if block.strip():
            reading = pj.ReadOptions(block_size=len(block) + 1, use_threads=False)
            yield from pj.read_json(io.BytesIO(block), reading, options).to_batches()


def aligned(batch: pa.RecordBatch, schema: pa.Schema, split: str) -> pa.RecordBatch:
    """The columns of the schema, missing ones null, ``split`` from the file's name."""
    columns = []
    for field in schema:
        if field.name == SPLIT:
            columns.append(pa.repeat(pa.scalar(split, field.type), batch.num_rows))
        elif field.name in batch.schema.names:
            columns.append(batch.column(field.name).cast(field.type))
        else:
            columns.append(pa.nulls(batch.num_rows, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def read_piece(root: str, piece: Piece, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    system, _ = file_system(root.split(SEPARATOR)[0])
    arrow = to_arrow_schema(schema)
    with system.open_input_file(piece.path) as file:
        if piece.kind == "parquet":
            batches = parquet_batches(file, piece)
        else:
            batches = json_batches(file, piece, pa.schema([f for f in arrow if f.name != SPLIT]))
        for batch in batches:
            yield aligned(batch, arrow, piece.split)


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.schema, self.splits = options["path"], schema, options.get("split")
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Piece]:
        wanted = chosen(found_files(self.path), self.splits)
        # Without any piece Spark would make one of its own.
        return pieces(wanted, self.size) or [Piece("", "", "", 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_piece(self.path, partition, self.schema)


class TrajectoryStream(DataSourceStreamReader):
    """New files of the list or directory, in the order in which they are found.

    The folder of the option ``log`` holds one list of files per offset. It is written before the
    offset is handed out, so a batch that is run again reads the same files, whatever their
    times. Files must appear whole, as those that Spark writes do.
    """

    def __init__(self, options: dict, schema: T.StructType) -> None:
        if "log" not in options:
            raise ValueError("a stream of trajectories needs the option `log`, a folder of its own")
        self.path, self.schema, self.splits = options["path"], schema, options.get("split")
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.system, self.log = file_system(options["log"])
        self.system.create_dir(self.log, recursive=True)
        self.last, self.seen = 0, set()

    def _entry(self, n: int) -> str:
        return f"{self.log.rstrip('/')}/{n}.json"

    def _catch_up(self) -> None:
        while self.system.get_file_info(self._entry(self.last + 1)).type == fs.FileType.File:
            self.last += 1
            self.seen |= {f.path for f in self._files(self.last)}

    def _files(self, n: int) -> list[Piece]:
        with self.system.open_input_file(self._entry(n)) as file:
            return [Piece(**row) for row in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        found = chosen(found_files(self.path, partial=True), self.splits)
        new = [f for f in found if f.path not in self.seen]
        if new:
            with self.system.open_output_stream(self._entry(self.last + 1) + ".part") as file:
                file.write(json.dumps([_row(f) for f in new]).encode())
            self.system.move(self._entry(self.last + 1) + ".part", self._entry(self.last + 1))
            self._catch_up()
        return {"lists": self.last}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [p for n in range(start["lists"] + 1, end["lists"] + 1) for p in pieces(self._files(n), self.size)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from read_piece(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        """The lists stay: they say which files are known."""


def _row(piece: Piece) -> dict:
    return {name: getattr(piece, name) for name in ("path", "kind", "split", "start", "end", "size")}


class TrajectorySource(DataSource):
    """Options: ``path`` (a ``||`` list or a directory), ``split``, ``partitionBytes``; for streams ``log``.

    The option ``split`` chooses files, so the others are not opened. It is no pushed filter, since
    Spark 4.1 keeps what it has pushed to a Python source for later queries on the same DataFrame,
    which would lose rows. The column ``split`` tells the split of a row's file; a column of that name in the data is not
    read, nor are other columns that only the names of folders hold. Without a schema the footers of the parquet files give one; JSON needs ``.schema(...)``.
    """

    @classmethod
    def name(cls) -> str:
        return "trajectories"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        system, _ = file_system(path.split(SEPARATOR)[0])
        files = found_files(path)
        if any(f.kind != "parquet" for f in files):
            raise ValueError("JSON files need a schema: spark.read.format(...).schema(...)")
        schemas = []
        for found in files:
            with system.open_input_file(found.path) as file:
                schema = pq.read_schema(file).remove_metadata()
            if schema not in schemas:
                schemas.append(schema)
        fields = from_arrow_schema(pa.unify_schemas(schemas, promote_options="permissive")).fields
        return T.StructType([*[f for f in fields if f.name != SPLIT], T.StructField(SPLIT, T.StringType())])

    def reader(self, schema: T.StructType) -> TrajectoryReader:
        return TrajectoryReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> TrajectoryStream:
        return TrajectoryStream(self.options, schema)


def register_source(spark: SparkSession) -> None:
    """Make the format ``trajectories`` known to the session."""
    spark.dataSource.register(TrajectorySource)
