"""Benchmark decontamination by SimHash over item-sized windows, in SQL functions alone.

Windows have an item's size, wherever the shingles they share with it stand; at the ends of a
document they are cut. Those that hold enough shingles of items of their size to reach the
threshold get a 64-bit SimHash of their shingles, each weighted by its count. Items are indexed
by blocks of their fingerprints: each block has a share of the radius, and an item within the
radius differs from the window by no more than that share in one block at least. The index holds
every value within the share, so a window looks up its own values alone. A shingle that comes many
times can turn many bits, so pairs of which one text repeats a shingle are candidates if they share
one, at any distance.
Candidates are verified by the exact weighted Jaccard similarity of the shingles.

Only ids, hashes and places leave the scan of the documents; a second one cuts the windows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import SHINGLE, table, words_column
from trajloom.operators.lookup import fits_broadcast
from trajloom.operators.store import store

THRESHOLD = 0.8
#: More than four deviations above the mean distance, 9.7, of texts at a similarity of 0.8.
RADIUS = 22
BITS = 64
#: Bits of a block: 268 index rows an item at the radius above.
BLOCK_BITS = 8


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def with_shingles(df: DataFrame, text: Column, size: int, name: str) -> DataFrame:
    """Add the hash of each run of ``size`` words; an empty array for fewer words.

    Each step is a projection of its own: an expression that a lambda names would be computed
    for every element.
    """
    hashed = df.withColumn("_words", words_column(text)).withColumn("_words", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.slice("_words", 1, F.greatest(F.size("_words") - size + 1, F.lit(0)))
    return hashed.withColumn(name, F.transform(starts, lambda _, i: F.xxhash64(*[F.get("_words", i + k) for k in range(size)])))


def fingerprint(shingles: Column) -> Column:
    """SimHash: a bit is 1 if most shingles, by count, have it. Null without shingles."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def bit(b: int) -> Column:
        ones = F.aggregate(shingles, zero, lambda n, x: n + F.shiftrightunsigned(x, b).bitwiseAND(one))
        return F.when(2 * ones > F.size(shingles), F.shiftleft(one, b)).otherwise(zero)

    bits = [bit(b) for b in range(BITS)]
    return F.when(F.size(shingles) > 0, reduce(lambda x, y: x.bitwiseOR(y), bits))


def block_shares(radius: int) -> list[tuple[int, int]]:
    """First bit and share of the radius of each block that has to be searched.

    If every block differed by more than its share, the shares plus one for each block would
    sum to more than the radius; a block of share -1 is left out.
    """
    share, rest = divmod(radius, BITS // BLOCK_BITS)
    shares = [share if k <= rest else share - 1 for k in range(BITS // BLOCK_BITS)]
    return [(k * BLOCK_BITS, min(n, BLOCK_BITS)) for k, n in enumerate(shares) if n >= 0]


def block_value(fingerprint: Column, first: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def blocks(fingerprint: Column, radius: int) -> Column:
    """An array of (block, value)."""
    return F.array(*[F.struct(F.lit(i).alias("block"), block_value(fingerprint, first).alias("value")) for i, (first, _) in enumerate(block_shares(radius))])


def near_blocks(fingerprint: Column, radius: int) -> Column:
    """An array of (block, value): all values within each block's share of the radius."""

    def values(i: int, first: int, share: int) -> Column:
        flips = [sum(1 << b for b in turned) for n in range(share + 1) for turned in combinations(range(BLOCK_BITS), n)]
        own = block_value(fingerprint, first)
        return F.transform(F.lit(flips), lambda flip: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(flip.cast("long")).alias("value")))

    return F.concat(*[values(i, *bounds) for i, bounds in enumerate(block_shares(radius))])


def first_near_block(x: Column, y: Column, radius: int) -> Column:
    """The first block in which two fingerprints lie within its share: the one whose match counts."""
    differ = x.bitwiseXOR(y)
    return F.coalesce(*[F.when(F.bit_count(block_value(differ, first)) <= share, F.lit(i)) for i, (first, share) in enumerate(block_shares(radius))])


def within_radius(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """The rows of ``windows`` (length, own, ...) with each item (_item, length, fp) of the same
    length within the radius, each pair once. No other pair leaves the join."""
    probes = windows.select("*", F.inline(blocks(F.col("own"), radius)))
    entries = items.select("_item", F.col("length").alias("_length"), "fp", F.inline(near_blocks(F.col("fp"), radius)))
    entries = store(entries.withColumnsRenamed({"block": "_block", "value": "_value"}), "blocks")
    found = (F.col("length") == F.col("_length")) & (F.col("block") == F.col("_block")) & (F.col("value") == F.col("_value"))
    near = F.bit_count(F.col("own").bitwiseXOR(F.col("fp"))) <= radius
    once = first_near_block(F.col("own"), F.col("fp"), radius) == F.col("block")
    return probes.join(small(entries), found & near & once).select(*windows.columns, "_item")


def item_table(benchmark: DataFrame, size: int, or_more: bool) -> DataFrame:
    """(item_id, n_words, shingles of ``size`` words) of the items with so many words, or more."""
    rows = with_shingles(benchmark.select("item_id", "text"), F.coalesce("text", F.lit("")), size, "shingles")
    rows = rows.withColumn("n_words", F.size("_words"))
    rows = rows.where(F.col("n_words") >= size if or_more else F.col("n_words") == size)
    return rows.select("item_id", "n_words", "shingles").distinct()


def small(df: DataFrame) -> DataFrame:
    """Broadcast if the measured size allows it; else Spark joins by shuffle."""
    return F.broadcast(df) if fits_broadcast(df) else df


def window_starts(spots: Column, n: Column, length: Column, threshold: float) -> Column:
    """Starts of the windows of ``length`` shingles that can reach the threshold, of a document of
    ``n`` shingles. ``spots`` are the sorted places of shingles that items of this length have.

    As a window moves on, its similarity to an item grows only when a spot enters at its end or,
    where the document's end cuts it, when a shingle before a spot leaves. So the first best
    window ends or begins at a spot. Of w shingles it must share t (w + length) / (1 + t), and
    shares no more than it has spots. A negative start is cut to 0, a shorter window.
    """

    def need(w: Column) -> Column:
        return F.ceil(F.lit(threshold) * (w + length) / F.lit(1 + threshold) - 1e-9).cast("int")

    def ending(at: Column, i: Column) -> Column:
        return F.when(F.get(spots, i + 1 - need(F.least(length, at + 1))) > at - length, at - length + 1)

    def beginning(at: Column, i: Column) -> Column:
        return F.when(F.get(spots, i - 1 + need(F.least(length, n - at))) < at + length, at)

    starts = F.concat(F.transform(spots, ending), F.transform(spots, beginning))
    return F.filter(starts, lambda start: start.isNotNull())


def same_document(x: DataFrame, y: DataFrame) -> Column:
    return x["doc_id"].eqNullSafe(y["_id"]) & (x["text_hash"] == y["_hash"])


def leaks_of_size(docs: DataFrame, items: DataFrame, size: int, threshold: float, radius: int) -> DataFrame:
    items = store(items.withColumns({"fp": fingerprint(F.col("shingles")), "_item": F.monotonically_increasing_id()}), "items")
    places = items.select(F.posexplode("shingles").alias("place", "shingle"), F.size("shingles").alias("length"))
    places = store(places.groupBy("shingle", "length").agg(F.collect_set("place").alias("places")), "places")
    # Spots: places of a document whose shingle some item has.
    text = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    shingles = with_shingles(text, F.col("text"), size, "all").select("doc_id", "text_hash", "all")
    # The outer form: else Spark would filter on the array's size below, and make it anew there.
    found = shingles.select("doc_id", "text_hash", F.size("all").alias("n"), F.posexplode_outer("all").alias("at", "shingle")).join(small(places), "shingle")
    sized = ["doc_id", "text_hash", "length"]
    spots = found.groupBy(*sized).agg(F.max("n").alias("n"), F.collect_set(F.struct("at", "places")).alias("found"))
    spots = spots.withColumn("spots", F.array_sort(F.transform("found", lambda x: x["at"])))
    spots = spots.withColumn("starts", window_starts(F.col("spots"), F.col("n"), F.col("length"), threshold))
    spots = store(spots.where(F.size("starts") > 0).select(*sized, "starts", "found"), "spots")
    # Beside them, the windows that have a shingle at an item's own place: a leak is reported there if it can be.
    aligned = spots.select(*sized, F.explode("found").alias("x")).select(*sized, "x.at", F.explode("x.places").alias("place"))
    starts = spots.select(*sized, F.explode("starts").alias("start")).union(aligned.select(*sized, F.col("at") - F.col("place"))).distinct()
    starts = starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("length", "start")).alias("starts"))
    starts = store(starts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts"), "starts")
    # Windows.
    leaky = text.join(small(starts), same_document(text, starts)).select("doc_id", "text_hash", "text", "starts")
    cut = with_shingles(leaky, F.col("text"), size, "all").select("doc_id", "text_hash", "all", F.inline_outer("starts"))
    first, last = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("length"), F.size("all"))
    windows = cut.select("doc_id", "text_hash", "length", "start", F.slice("all", first + 1, last - first).alias("window"))
    keys = [*sized, "start"]
    windows = store(windows.groupBy(*keys).agg(F.first("window").alias("window")), "windows")
    windows = windows.select("*", fingerprint(F.col("window")).alias("own"))
    # Candidates: items of the same size within the radius.
    sized_items = items.select("_item", "fp", F.size("shingles").alias("length"))
    near = within_radius(windows, sized_items, radius).select(*keys, "window", "_item")
    # Repeated shingles: candidates by the shingles themselves.
    repeats = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    held = items.select("_item", F.size("shingles").alias("length"), repeats(F.col("shingles")).alias("twice"), F.explode(F.array_distinct("shingles")).alias("shingle"))
    sought = windows.select(*keys, "window", repeats(F.col("window")).alias("again"), F.explode(F.array_distinct("window")).alias("shingle"))
    alike = sought.join(small(store(held, "held")), ["length", "shingle"]).where(F.col("twice") | F.col("again"))
    near = near.union(alike.select(*keys, "window", "_item")).distinct()
    # Verification: the shared weight of each shingle, summed up per window and item.
    # A window is aligned if a shingle stands at its own place in the item.
    part = F.slice("shingles", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("window"))
    own_place = F.exists(F.zip_with("window", part, lambda x, y: x == y), lambda same: same)
    near = near.join(small(items.select("_item", "shingles")), "_item").withColumn("aligned", F.coalesce(own_place, F.lit(False)))
    pairs = ["doc_id", "text_hash", "length", "start", "aligned", "_item"]
    counted = near.select(*pairs, F.size("window").alias("n"), F.explode("window").alias("shingle")).groupBy(*pairs, "n", "shingle").agg(F.count(F.lit(1)).alias("have"))
    wanted = items.select("_item", F.explode("shingles").alias("shingle")).groupBy("_item", "shingle").agg(F.count(F.lit(1)).alias("want"))
    both = counted.join(small(store(wanted, "weights")), ["_item", "shingle"])
    shared = both.groupBy(*pairs, "n").agg(F.sum(F.least("have", "want")).alias("shared"))
    similarity = F.col("shared") / (F.col("n") + F.col("length") - F.col("shared"))
    exact = shared.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    names = items.select("_item", "item_id", "n_words")
    return exact.join(small(names), "_item").select("doc_id", "text_hash", "item_id", "n_words", "aligned", "start", "similarity")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, start, similarity): the best window of each
    document (doc_id, text) for each item (item_id, text) it leaks; the first one in ties. Windows
    that have a shingle at its own place in the item come before all others.

    ``start`` counts words from 0. Items shorter than a shingle are sought as one shingle of
    all their words; items and documents that are null or have no words match nothing.
    Rows of equal id and text, and items of equal id and text, give one result; ids may be
    null. ``text_hash`` tells documents of equal ids apart.
    """
    words = F.size(words_column(F.coalesce("text", F.lit(""))))
    # At most ``shingle`` rows.
    sizes = benchmark.select(F.least(words, F.lit(shingle)).alias("words")).where("words > 0").distinct().collect()
    found = [
        leaks_of_size(docs, item_table(benchmark, row.words, row.words == shingle), row.words, threshold, radius)
        for row in sorted(sizes)
    ]
    if not found:
        fields = [docs.schema["doc_id"], benchmark.schema["item_id"]]
        schema = T.StructType([fields[0], T.StructField("text_hash", T.LongType()), fields[1]])
        empty = docs.sparkSession.createDataFrame([], schema)
        return empty.selectExpr("*", "0 AS n_words", "0 AS start", "0D AS similarity")
    leaks = reduce(DataFrame.union, found)
    place = F.greatest("start", F.lit(0)).alias("start")
    best = F.max_by(F.struct("n_words", place, "similarity"), F.struct("aligned", "similarity", -F.col("start")))
    return leaks.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all columns."""
    marked = leaks.select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), docs["doc_id"].alias("_id"), text_hash(docs["text"]).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_leak_id")) & (F.col("_hash") == F.col("_leak_hash"))
    return rows.join(marked, same, "left_anti").select("doc.*")


def leaked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of ``documents`` leak which items of ``benchmark``, and where."""
    leaks = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start", "similarity")
