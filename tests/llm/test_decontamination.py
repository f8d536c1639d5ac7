import math
import random

import pytest
from brute import jaccard, words
from collections import Counter
from pyspark.sql import functions as F

from trajloom.llm import decontam
from trajloom.llm.queries import QUERIES


def runs(text, size):
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def expected(docs, items, threshold=0.8):
    """The best of the windows that have an item's size and a shingle at the item's place."""
    out = {}
    for doc_id, text in docs:
        runs_of = {size: runs(text, size) for size in range(1, 6)}
        for item_id, item in items:
            size = min(5, len(words(item)))
            if not size or text is None:
                continue
            want, have = runs(item, size), runs_of[size]
            places = {}
            for place, run in enumerate(want):
                places.setdefault(run, []).append(place)
            starts = {at - place for at, run in enumerate(have) for place in places.get(run, ())}
            best = None
            for start in sorted(starts):
                window = have[max(start, 0) : start + len(want)]
                similarity = jaccard(Counter(window), Counter(want))
                if similarity >= threshold and (best is None or similarity > best[1]):
                    best = (max(start, 0), similarity)
            if best:
                out[doc_id, item_id] = best
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.start, pytest.approx(r.similarity)) for r in df.collect()}


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(QUERIES["op4_decontamination"](spark, sf)) == expected(docs, items)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(1)
    text = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    items = [(i, " ".join(text(draw.randint(20, 60)))) for i in range(25)]
    items += [(100, "one two three"), (101, "Single"), (102, ""), (103, None), (104, "!!"), (105, items[0][1]), (106, "r s " * 20)]
    docs = []
    for i in range(60):
        item = items[i % 25][1].split()
        if i % 3 == 1:
            item[2] = "changed"
        if i % 3 == 2:
            item.insert(len(item) - 2, "more")
        docs.append((i, " ".join(text(draw.randint(0, 80)) + item + text(draw.randint(0, 30)))))
    docs += [(200, "say ONE, two three."), (201, "single"), (202, "one two"), (203, ""), (204, None), (205, "x r s" + " r s" * 22), (206, items[3][1].upper()), (207, " ".join(text(40000)) + " " + items[4][1])]
    return docs, items


def test_planted_items(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, start int, shingle string").repartition(4)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, place int")
    leaks = decontam.find_leaks(d, b)
    assert found(leaks) == expected(docs, items)
    kept = decontam.without_leaks(d, leaks)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in expected(docs, items)}
    # Beyond the broadcast limit all joins are shuffles, with the same result.
    original, decontam.small = decontam.small, lambda df: df
    try:
        assert found(decontam.find_leaks(d, b)) == expected(docs, items)
    finally:
        decontam.small = original


def test_odd_rows(spark, odd_documents, empty_documents):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, "une phrase courte mais claire")], "item_id long, text string")
    leaks = decontam.find_leaks(odd_documents, items)
    assert sorted((tuple(r)[0], tuple(r)[2]) for r in leaks.collect() if r.doc_id) == [(1, 1), (2, 1)]
    assert decontam.without_leaks(odd_documents, leaks).count() == odd_documents.count() - 4
    assert decontam.find_leaks(empty_documents, items).collect() == []
    none = decontam.find_leaks(odd_documents, items.limit(0))
    assert none.collect() == [] and decontam.without_leaks(odd_documents, none).count() == odd_documents.count()


def test_blocks_find_all_within_the_radius(spark):
    draw = random.Random(7)
    rows = []
    for distance in range(0, 25):
        for _ in range(20):
            x, y = draw.getrandbits(64), 0
            for bit in draw.sample(range(64), distance):
                y |= 1 << bit
            rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, x ^ y)) + (distance,))
    df = spark.createDataFrame(rows, "x long, y long, distance int")
    for radius in (0, 3, 15, 22):
        first = decontam.first_near_block(F.col("x"), F.col("y"), radius)
        assert df.where((F.col("distance") <= radius) & first.isNull()).isEmpty()


@pytest.mark.parametrize("radius", [0, 5, 22])
def test_index_finds_each_pair_within_the_radius_once(spark, radius):
    draw = random.Random(radius)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    items = [(i, draw.randrange(2), draw.getrandbits(64)) for i in range(60)]
    windows = [(i, draw.randrange(2), draw.getrandbits(64)) for i in range(400)]
    for k, (_, length, fp) in enumerate(items * 5):
        windows.append((1000 + k, length, fp ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(26)))))
    w = spark.createDataFrame([(i, n, signed(x)) for i, n, x in windows], "w long, length int, own long")
    i = spark.createDataFrame([(i, n, signed(x)) for i, n, x in items], "_item long, length int, fp long")
    pairs = sorted((r.w, r._item) for r in decontam.within_radius(w, i, radius).collect())
    assert pairs == sorted((a, b) for a, n, x in windows for b, m, y in items if n == m and (x ^ y).bit_count() <= radius)


def test_index_selects():
    # Lookups that hit, per pair of unrelated fingerprints, and index rows per item.
    hits = sum(sum(math.comb(8, n) for n in range(share + 1)) for _, share in decontam.block_shares(decontam.RADIUS))
    assert hits == 268 and hits / 256 < 1.05


def test_main_path_is_native(spark, tables):
    docs, items = tables
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontam.find_leaks(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def leaking_pairs(docs, items, threshold=0.8):
    """The pairs of which any window of the item's size, at whatever start, reaches the threshold."""
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            size = min(5, len(words(item)))
            if not size or text is None:
                continue
            want, have = Counter(runs(item, size)), runs(text, size)
            length = sum(want.values())
            spots = [i for i, run in enumerate(have) if run in want]
            for start in {s for i in spots for s in range(i - length + 1, i + 1)}:
                if jaccard(Counter(have[max(start, 0) : start + length]), want) >= threshold:
                    out.add((doc_id, item_id))
                    break
    return out


def test_windows_lie_anywhere(spark):
    draw = random.Random(3)
    text = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    items = [text(n) for n in (50, 50, 60, 90, 47)]
    docs = []
    for k, item in enumerate(items):
        for before, after in ((0, 0), (0, 9), (31, 0), (70, 70)):
            for cut in (len(item) // 2, 7, 12, len(item) - 8):
                docs.append(text(before) + item[cut:] + item[:cut] + text(after))
            docs.append(text(before) + item[cut:] + text(k) + item[:cut] + text(after))
            docs.append(text(before) + item[: len(item) - 3] + text(after))
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(None, " ".join(items[0][25:] + items[0][:25]))]
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    # Without a loss by the fingerprints.
    leaks = decontam.find_leaks(d, b, radius=40)
    wanted = leaking_pairs(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == wanted
    assert (0, 0) in wanted and (None, 0) in wanted and (0, 0) not in expected(docs, items)
    assert {r.doc_id for r in decontam.without_leaks(d, leaks).collect()} == {i for i, _ in docs} - {i for i, _ in wanted}


def test_no_leak_at_the_threshold_is_lost(spark):
    draw = random.Random(5)
    text = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    # 40 of 45 shingles are shared: 0.8. Then texts that end in one word many times over.
    items = [text(49) for _ in range(250)]
    docs = [item[:44] + text(5) for item in items]
    for _ in range(12):
        items.append(text(166) + ["z"] * 18)
        docs.append(items[-1][:166] + ["y"] * 18)
    docs, items = ([(i, " ".join(t)) for i, t in enumerate(rows)] for rows in (docs, items))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, b).collect()} == {(i, i) for i, _ in docs}
