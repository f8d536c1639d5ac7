"""Packing token sequences into windows of fixed size by minimum bin slack.

A document's full windows stand alone. What remains of each document, fewer tokens than a
window, is packed whole: over the histogram of remaining lengths, whose size the window
bounds whatever the data, a subset-sum table kept as one bit set per step finds the
multiset of lengths that fills a window closest to its capacity; walking the steps back
gives its counts, and the multiset is used as often as the histogram allows. When no
multiset leaves the allowed slack any more, the rest is laid end to end and cut, the last
window at powers of two, so that it needs no padding either.

The plan is made on the driver from the histogram alone; rows get their rank among those
of equal length from a sort by range and look up their place by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm.common import WORDS_BYTES, crc32, encoder, running_sums, slices, table, tagged

CAPACITY = 2048
#: The rank of a remainder stays below 2**RANK_BITS.
RANK_BITS = 48
PIECES = "start long, length long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` of a sub-multiset, and its counts by length.

    Bit s of ``reach`` is set if some multiset of the lengths seen sums to s. Lengths go in
    from the longest, in lots of 1, 2, 4, ...; the walk back takes a lot only if the sum
    can't be reached without it, so long lengths are used up first.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, lot = min(counts[length], capacity // length), 1
        while left > 0:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            left, lot = left - lot, lot * 2
        if reach >> capacity:
            break
    best = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + lot
            at -= length * lot
    return best, chosen


@dataclass
class PackPlan:
    """Places for (length, rank): runs of ranks that go into copies of one pattern, and the
    tail. All arrays are bounded by the capacity, not by the number of rows."""

    capacity: int
    keys: np.ndarray  # length << RANK_BITS | first rank, ascending
    each: np.ndarray  # pieces of the length in one window
    window: np.ndarray  # first window
    offset: np.ndarray  # place of the first piece in the window
    tail: dict[int, tuple[int, int]]  # length: its first rank in the tail, place of that
    cuts: np.ndarray  # where the windows of the tail's last part begin
    tail_window: int
    windows: int

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, window, offset) of each piece of a remainder."""
        if length in self.tail and rank >= self.tail[length][0]:
            first, place = self.tail[length]
            return self._cut(length, place + (rank - first) * length)
        at = int(np.searchsorted(self.keys, (length << RANK_BITS) | rank, "right")) - 1
        copy, inside = divmod(rank - (int(self.keys[at]) & ((1 << RANK_BITS) - 1)), int(self.each[at]))
        return [(0, length, int(self.window[at]) + copy, int(self.offset[at]) + inside * length)]

    def _cut(self, length: int, place: int) -> list[tuple[int, int, int, int]]:
        found, start = [], 0
        while start < length:
            if place < self.cuts[0]:
                number, offset = divmod(place, self.capacity)
                end = place - offset + self.capacity
            else:
                i = int(np.searchsorted(self.cuts, place, "right")) - 1
                number, offset, end = int(self.cuts[0]) // self.capacity + i, place - int(self.cuts[i]), int(self.cuts[i + 1])
            size = min(length - start, end - place)
            found.append((start, size, self.tail_window + number, offset))
            start, place = start + size, place + size
        return found


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, max_slack: int = 0) -> PackPlan:
    """Pack a histogram of lengths below ``capacity``."""
    left = {int(k): int(n) for k, n in counts.items() if k > 0 and n > 0}
    if any(k >= capacity for k in left):
        raise ValueError("a remainder must be shorter than a window")
    used, runs, windows = dict.fromkeys(left, 0), [], 0
    while left:
        total, chosen = closest_fill(left, capacity)
        if capacity - total > max_slack:
            break
        copies, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length, n in chosen.items():
            runs.append(((length << RANK_BITS) | used[length], n, windows, offset))
            offset += length * n
            used[length] += n * copies
            left[length] -= n * copies
            if not left[length]:
                del left[length]
        windows += copies
    tail, place = {}, 0
    for length in sorted(left, reverse=True):
        tail[length] = (used[length], place)
        place += length * left[length]
    rest, cuts = place % capacity, [place - place % capacity]
    for bit in reversed(range(capacity.bit_length())):
        if rest >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    columns = np.array(sorted(runs), np.int64).reshape(-1, 4).T
    total = windows + place // capacity + len(cuts) - 1
    return PackPlan(capacity, *columns, tail, np.array(cuts, np.int64), windows, total)


def tokenised(df: DataFrame, tokenizer: str, kind: str, end_id: int, keep: list[str]) -> DataFrame:
    """Written: the kept columns, ``_row``, ``n_tokens`` and the packed ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(tokenizer, kind, end_id).encode_many, zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            for part in slices(batch, "text", WORDS_BYTES):
                ids = encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([pack_ids(pack, i) for i in ids], pa.binary())],
                    names=[*keep, "n_tokens", "ids"],
                )

    columns = df.select(*keep, F.col("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keep)
    return tagged(columns.mapInArrow(run, f"{kept}, n_tokens long, ids binary"), "tokens")


def pack_ids(pack: zstandard.ZstdCompressor, ids: bytes) -> bytes:
    """Low halves of all ids, then high halves: the latter nearly vanish when packed."""
    halves = np.frombuffer(ids, "<u2").reshape(-1, 2)
    return pack.compress(halves.T.tobytes())


def unpack_ids(packed: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u2").reshape(2, -1)
    return np.ascontiguousarray(halves.T).view("<u4").ravel()


def place_rows(sizes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, PackPlan, int]:
    """(_row, n_tokens) with ``_full`` (full windows of all rows before) and ``_rank`` (rows
    of the same remainder before), the plan of the remainders, and the number of full windows."""
    rows = sizes.withColumns(
        {"_length": F.col("n_tokens") % capacity, "_windows": F.floor(F.col("n_tokens") / capacity).cast("long"), "_one": F.lit(1).cast("long")}
    )
    # At most ``capacity`` rows.
    groups = rows.groupBy("_length").agg(F.count("_row").alias("n"), F.sum("_windows").alias("windows")).collect()
    counts = {g["_length"]: g["n"] for g in groups}
    plan = plan_packing(counts, capacity)
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    placed = running_sums(rows, [F.col("_length"), F.col("_row")], {"_at": "_one", "_full": "_windows"}, name="placed")
    # An Arrow table becomes rows in the JVM; a list would be read by Python workers of its own.
    firsts = np.array(sorted(before.items()) or [(0, 0)], np.int64)
    starts = sizes.sparkSession.createDataFrame(pa.table({"_length": firsts[:, 0], "_first": firsts[:, 1]}))
    placed = placed.join(F.broadcast(starts), "_length").withColumn("_rank", F.col("_at") - F.col("_first"))
    return placed.select("_row", "_full", "_rank"), plan, sum(g["windows"] for g in groups)


def pack(tokens: DataFrame, keep: list[str], capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of the rows of :func:`tokenised`: the kept columns, ``n_tokens``, ``start``,
    ``length``, ``sequence_id``, ``offset``, ``ids_crc32`` and, if wanted, the ids.

    The pieces of a sequence lie gapless from offset 0. Rows without tokens have no piece.
    """
    places, plan, full_windows = place_rows(tokens.select("_row", "n_tokens"), capacity)
    rows = tokens.join(places, "_row")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in keep)
    schema = f"{kept}, n_tokens long, {PIECES}, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield cut(batch.slice(at, 512))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, out, crcs, ids_out = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("ids", "n_tokens", "_full", "_rank"))
        for i, (packed, n, full, rank) in enumerate(zip(*columns)):
            ids, whole = unpack_ids(packed), n // capacity * capacity
            pieces = [(k * capacity, capacity, full + k, 0) for k in range(n // capacity)]
            if n > whole:
                pieces += [(whole + s, size, full_windows + w, o) for s, size, w, o in plan.pieces(n - whole, rank)]
            for piece in pieces:
                part = ids[piece[0] : piece[0] + piece[1]]
                source.append(i)
                out.append(piece)
                crcs.append(crc32(part.tobytes()))
                if with_ids:
                    ids_out.append(part.astype(np.int32))
        values = np.array(out, np.int64).reshape(-1, 4).T
        taken = pa.array(source, pa.int64())
        arrays = [*(batch.column(c).take(taken) for c in keep), batch.column("n_tokens").take(taken), *map(pa.array, values), pa.array(crcs, pa.int64())]
        if with_ids:
            arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
        names = [*keep, "n_tokens", "start", "length", "sequence_id", "offset", "ids_crc32", *["ids"] * with_ids]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema)


def pack_table(docs: DataFrame, tokenizer: str | None = None, kind: str = "spaced", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, doc_tokens, start, length, sequence_id, offset, ids_crc32.

    A null or empty text has the end id alone. Rows are told apart by place, not by doc_id,
    so null and repeated ids do no harm. An empty table has no pieces. Further columns are
    not read. Full windows have the sequence ids from 0, packed ones follow.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokens = tokenised(docs, tokenizer, kind, end_id, ["doc_id"])
    pieces = pack(tokens, ["doc_id"], capacity, with_ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return pieces.withColumnRenamed("n_tokens", "doc_tokens").select(*names)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_table(table(spark, sf_dir, "documents"))
