"""Near-duplicates by weighted Jaccard similarity of word shingles, with BagMinHash.

A text is the multiset of its runs of five words. For every element and every dyadic
interval of weights below its count runs a Poisson process whose points carry a signature
component; a point in an interval that the count only partly covers is placed in it bit by
bit, and counts if it lies below. A component of the signature is the time of its first
point over all processes, so two texts agree in a component with exactly their weighted
Jaccard similarity. Processes stop at the largest component found so far.

Equal texts are one node. Signatures are cut into bands; nodes that share a band are
candidates. Each bucket's nodes are first compared with the bucket's leader alone, the node
with the most company. The links found so far give classes, and only nodes of a bucket that
are still in different classes are compared with each other, and only if what each of them
shares with the leader leaves room for a link. Every comparison is exact, on whole multisets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import SHINGLE, WORDS_BYTES, batch_words, mix, shingle_hashes, slices, store_by_batches, table, text_bytes
from trajloom.operators.lookup import fits_broadcast, lookup_join
from trajloom.operators.store import store

THRESHOLD = 0.8
BANDS, ROWS = 36, 7
NO_ID = (1 << 63) - 1
# Nodes of one leader that a task may always take.
SPLIT_ROWS = 1000
_STEP = np.uint64(0xD1342543DE82EF95)


# ---------------------------------------------------------------- multisets and signatures


def multisets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and the first of each
    text (and the end)."""
    shingles, bounds = shingle_hashes(*batch_words(texts), size)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(text)))
    return shingles[at], counts, np.searchsorted(text[at], np.arange(len(texts) + 1))


def signatures(shingles: np.ndarray, counts: np.ndarray, bounds: np.ndarray, components: int) -> np.ndarray:
    """One row of ``components`` times per text; infinite for a text without shingles."""
    texts = len(bounds) - 1
    out = np.full(texts * components, np.inf)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    # The interval below 1, and then [1, 2), [2, 4), [4, 8), ... below the count.
    element, low, high = [np.arange(len(shingles))], [np.zeros(len(shingles), np.int64)], [np.ones(len(shingles), np.int64)]
    edge = 1
    while len(more := np.flatnonzero(counts > edge)):
        element.append(more)
        low.append(np.full(len(more), edge))
        high.append(np.full(len(more), 2 * edge))
        edge *= 2
    element, low, high = map(np.concatenate, (element, low, high))
    seed = mix(shingles[element] ^ mix(high.astype(np.uint64)))
    width, limit, text = (high - low).astype(float), counts[element] - low, owner[element]
    time, step, points = np.zeros(len(element)), 0, 1
    while len(seed):
        draw = mix(seed[:, None] + np.arange(step + 1, step + points + 1, dtype=np.uint64)[None, :] * _STEP)
        gaps = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        draw = mix(draw)
        component = ((draw >> np.uint64(32)) * np.uint64(components)) >> np.uint64(32)
        # The place in the interval: its bits are the halves chosen on the way down.
        place = ((draw & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32) * width[:, None]
        taken = place < limit[:, None]
        target = text[:, None] * components + component.astype(np.int64)
        np.minimum.at(out, target[taken], times[taken])
        time, step = times[:, -1], step + points
        points = min(points * 2, 64) if step > 1 else 1
        most = out.reshape(texts, components).max(axis=1)
        live = time < most[text]
        seed, width, limit, text, time = seed[live], width[live], limit[live], text[live], time[live]
    return out.reshape(texts, components)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    values = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    keys = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), values.shape[:2])
    for k in range(values.shape[2]):
        keys = mix(keys ^ values[:, :, k])
    return keys.astype(np.int64)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Written: doc_id, the text's key (null for a null text) and its band keys, one row per
    row of ``docs``. A text without words has no band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", WORDS_BYTES):
                shingles, counts, bounds = multisets(text_bytes(part.column("text")), size)
                keys = band_keys(signatures(shingles, counts, bounds, bands * rows), bands)
                some = np.diff(bounds) > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), lists], names=["doc_id", "key", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), "text")
    return store_by_batches(rows_in.mapInArrow(run, "doc_id long, key binary, bands array<long>"), "sketches")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


# ---------------------------------------------------------------- exact comparison


def packed_multisets(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, bag) of (node, text): the distinct shingles and their counts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", WORDS_BYTES):
                shingles, counts, bounds = multisets(text_bytes(part.column("text")), size)
                bags = [
                    shingles[a:b].tobytes() + (b"" if (counts[a:b] == 1).all() else counts[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(bounds)), pa.array(bags, pa.binary())], names=["node", "n", "bag"])

    return texts.mapInArrow(run, "node long, n long, bag binary")


def unpacked(n: int, bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    shingles = np.frombuffer(bag, np.uint64, n)
    counts = np.frombuffer(bag, "<u4", n, 8 * n).astype(np.int64) if len(bag) > 8 * n else np.ones(n, np.int64)
    return shingles, counts


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(int(a[1].sum()) + int(b[1].sum()) - common, 1)


@F.pandas_udf(T.DoubleType())
def similarity(n_a: pd.Series, bag_a: pd.Series, n_b: pd.Series, bag_b: pd.Series) -> pd.Series:
    return pd.Series([overlap(unpacked(n, x), unpacked(m, y)) for n, x, m, y in zip(n_a, bag_a, n_b, bag_b)], dtype=float)


def compared(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b), written. A frequent ``a`` is split when joined."""
    left = bags.select(F.col("node").alias("a"), F.col("n").alias("_n_a"), F.col("bag").alias("_bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("n").alias("_n_b"), F.col("bag").alias("_bag_b"))
    rows = pairs.join(right, "b").join(left, "a")
    return store_by_batches(rows.select("a", "b", similarity("_n_a", "_bag_a", "_n_b", "_bag_b").alias("similarity")), "compared")


# ---------------------------------------------------------------- classes


def components(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, label): every node of (node, rank) with the smallest (rank, node) it is linked to,
    over any number of links (a, b).

    Labels pass along links and then jump to their label's label, so chains shrink by halves;
    each round is written. Nodes and labels of any frequency are split when joined.
    """
    own = F.struct("rank", "node")
    both = store(links.select("a", "b").union(links.select("b", "a")), "links")
    linked = both.select(F.col("a").alias("node")).distinct()
    labels = store(ranks.join(linked, "node").select("node", own.alias("label")), "labels")
    while True:
        passed = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        best = labels.union(passed).groupBy("node").agg(F.min("label").alias("label"))
        best = store(best, "labels")
        of = best.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        jumped = best.join(of, F.col("label.node") == F.col("_node")).select("node", F.least("label", "_label").alias("label"))
        jumped = store(jumped, "labels")
        old = labels.select("node", F.col("label").alias("_old"))
        if jumped.join(old, "node").where(F.col("label") != F.col("_old")).isEmpty():
            break
        labels = jumped
    return ranks.join(labels, "node", "left").select("node", F.coalesce("label", own).alias("label"))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and (key, rank, node, label) of each distinct text: its smallest id,
    and as label the rank and node of the text that stands for its class."""
    sketches = sketch(docs, bands, rows, size)
    nodes = sketches.where(F.col("key").isNotNull()).groupBy("key")
    nodes = nodes.agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rank"), F.first("bands").alias("bands"))
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    ranks = nodes.select("node", "rank")
    members = buckets(nodes)
    pairs = store(members.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), "pairs")
    # Only texts that are in some pair are read again.
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", "key", "rank"), "node")
    # Of equal texts one row is enough: that with the smallest id, and of those any.
    texts = docs.select(rank_of("doc_id").alias("rank"), text_key(F.col("text")).alias("key"), "text")
    found = texts.join(wanted, ["key", "rank"]).select("node", "text")
    bags = store_by_batches(packed_multisets(found, size).dropDuplicates(["node"]), "bags")
    links = compared(pairs, bags)
    labels = components(links.where(F.col("similarity") >= threshold), ranks)
    rest = rest_pairs(members, labels, links, bags, threshold)
    if not rest.isEmpty():
        links = links.union(compared(rest, bags))
        labels = components(links.where(F.col("similarity") >= threshold), ranks)
    return sketches, nodes.drop("bands").join(labels, "node")


def buckets(nodes: DataFrame) -> DataFrame:
    """(node, bucket, a) for every bucket of two nodes or more, written; ``a`` leads it.

    The leader is the node with the most company over all its buckets: the text that the
    others are copies of agrees with each of them in more bands than they do with each other.
    """
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = store(members.join(sizes, "bucket"), "members")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    known = members.select("node", "bucket").join(company, "node")
    leaders = known.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("_lead"))
    leaders = leaders.select("bucket", (-F.col("_lead.node")).alias("a"))
    return store(members.select("node", "bucket").join(leaders, "bucket"), "buckets")


def rank_of(doc_id: str) -> Column:
    """The id as a rank: no id comes last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the class, null if no row of it has one. Rows with
    equal texts are one class. Texts without words are alike only if equal; a null text is a
    class of its own doc_id. Classes are the connected components of links of at least
    ``threshold``. Further columns are not read.
    """
    sketches, texts = text_classes(docs, threshold, bands, rows, size)
    classes = texts.select("key", F.col("label.rank").alias("class_id"))
    rows_out = sketches.join(classes, "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).when(F.col("class_id") != NO_ID, F.col("class_id"))
    return rows_out.select("doc_id", class_id.alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns: of each class the one with the smallest doc_id.

    Of rows that agree in id and text any one stays; rows with a null text all stay.
    """
    sketches, texts = text_classes(docs, threshold)
    kept = texts.where(F.col("label.node") == F.col("node")).select("key", "rank")
    copies = sketches.groupBy("key", rank_of("doc_id").alias("rank")).agg(F.count(F.lit(1)).alias("copies"))
    kept = store(kept.join(copies, ["key", "rank"]), "kept")
    rows = docs.select(F.struct("*").alias("doc"), text_key(docs["text"]).alias("key"), rank_of("doc_id").alias("rank"))
    single = rows.join(kept.where(F.col("copies") == 1).select("key", "rank"), ["key", "rank"], "left_semi")
    parts = [single.select("doc.*"), docs.where(docs["text"].isNull())]
    repeated = kept.where(F.col("copies") > 1).select("key", "rank")
    if not repeated.isEmpty():
        again = rows.join(repeated, ["key", "rank"], "left_semi")
        parts.append(again.groupBy("key", "rank").agg(F.first("doc").alias("doc")).select("doc.*"))
    return reduce(DataFrame.union, parts)


RELATION = T.StructType(
    [T.StructField("common", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("lead", T.LongType()), T.StructField("more", T.ArrayType(T.LongType()))]
)


@F.pandas_udf(RELATION)
def relation(n_a: pd.Series, bag_a: pd.Series, n_b: pd.Series, bag_b: pd.Series) -> pd.DataFrame:
    """What b shares with a, both weights, and the shingles that b has more often than a."""
    out = []
    for n, x, m, y in zip(n_a, bag_a, n_b, bag_b):
        (has_a, count_a), (has_b, count_b) = unpacked(n, x), unpacked(m, y)
        _, i, j = np.intersect1d(has_a, has_b, assume_unique=True, return_indices=True)
        more = np.ones(len(has_b), bool)
        more[j] = count_b[j] > count_a[i]
        out.append((int(np.minimum(count_a[i], count_b[j]).sum()), int(count_b.sum()), int(count_a.sum()), has_b[more].view(np.int64)))
    return pd.DataFrame(out, columns=RELATION.names)


def rest_pairs(members: DataFrame, labels: DataFrame, links: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a bucket that are in different classes, were not compared yet, and that may be
    linked for all that their relation to the bucket's leader tells; written.

    Of a pair (x, y) with a link, let x not be linked to the leader. Either x and y have some
    shingle more often than the leader has it; such pairs meet on (leader, shingle). Or all
    they share is in the leader, and so is no more than what either shares with it, which
    bounds the weight of each by that of the other; such pairs meet on (leader, class of
    weights). Without either there is no link.
    """
    rows = members.join(labels.select("node", F.col("label.node").alias("own")), "node")
    mixed = rows.groupBy("bucket").agg(F.min("own").alias("_least"), F.max("own").alias("_most"))
    mixed = mixed.where(F.col("_least") != F.col("_most")).select("bucket")
    rows = rows.join(mixed, "bucket").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"), "own").distinct()
    left = bags.select(F.col("node").alias("a"), F.col("n").alias("_n_a"), F.col("bag").alias("_bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("n").alias("_n_b"), F.col("bag").alias("_bag_b"))
    related = rows.join(right, "b").join(left, "a")
    related = store_by_batches(related.select("a", "b", "own", relation("_n_a", "_bag_a", "_n_b", "_bag_b").alias("r")).select("a", "b", "own", "r.*"), "related")
    t = F.lit(threshold)
    # A little more than the bound, so that rounding loses no pair that just meets it.
    room = ((1 + t) * F.col("common") - t * F.col("weight")) / t + 1e-6
    size = lambda w: F.floor(F.ln(w) / F.log(F.lit(1.05)))
    related = related.withColumns({"room": room, "far": F.col("common") < t / (1 + t) * (F.col("weight") + F.col("lead"))})
    # Groups that have a node without a link to the leader; others are one class.
    # A leader's nodes lie in many tasks: they are not dealt by it alone.
    open_groups = store(related.where("far").groupBy("a").agg(F.lit(True).alias("open")), "open-groups")
    related = lookup_join(related, open_groups, ["a"], ["b"], fits_broadcast(open_groups), SPLIT_ROWS).where("open").drop("open")
    related = store(related, "related")
    # Pairs that share what the leader lacks.
    extra = related.select("a", "b", "own", "far", F.explode("more").alias("shingle"))
    who = [F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("_sum"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("_check"), F.count(F.lit(1)).alias("_n")]
    shared = extra.groupBy("a", "shingle").agg(F.min("own").alias("_least"), F.max("own").alias("_most"), F.max("far").alias("_far"), *who)
    shared = shared.where((F.col("_least") != F.col("_most")) & F.col("_far"))
    # Shingles that the same nodes share, as those around one changed word, give the same pairs.
    shared = shared.groupBy("a", "_sum", "_check", "_n").agg(F.min("shingle").alias("shingle")).select("a", "shingle")
    extra = store(extra.join(shared, ["a", "shingle"]), "extra")
    meet = _cross(extra, extra.where("far"), ["a", "shingle"], F.lit(True))
    # Pairs whose weights allow a link within the leader.
    sized = related.where("weight > 0").withColumn("size", size(F.col("weight")))
    fits = related.where("far AND room >= weight * %r" % threshold).withColumn(
        "size", F.explode(F.sequence(size(F.col("weight") * t), size(F.col("room"))))
    )
    fit = (F.col("y.room") >= F.col("x.weight")) & (F.col("x.room") >= F.col("y.weight"))
    within = _cross(sized, fits, ["a", "size"], fit)
    pairs = meet.union(within).distinct()
    known = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return store(pairs.join(known, ["a", "b"], "left_anti"), "rest")


def _cross(rows: DataFrame, far: DataFrame, keys: list[str], also: Column) -> DataFrame:
    """Pairs (a, b), smaller first, of a far row with any row of the same keys and another class."""
    x, y = far.alias("x"), rows.alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    # Two far rows meet in one order only.
    once = ~F.col("y.far") | (F.col("x.b") < F.col("y.b"))
    pairs = x.join(y, same & (F.col("x.own") != F.col("y.own")) & once & also)
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each row of ``documents``."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
