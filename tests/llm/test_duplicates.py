import random

import numpy as np
import pytest
from brute import classes, jaccard, shingles

from trajloom.llm import neardup
from trajloom.llm.queries import QUERIES


def varied(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Families of copies with more and more changes, a shared passage, repeats and odd texts."""
    draw = random.Random(11)
    text = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    out, passage = [], text(60)
    for _ in range(12):
        base = text(draw.randint(40, 400))
        out += [varied(draw, base, c) for c in (0, 0, 1, 1, 2, 3, 5, 8)]
    chain = text(300)
    for step in range(15):  # each near the one before, the ends far apart
        chain = [f"c{step}x{i}" if step * 6 <= i < step * 6 + 4 else w for i, w in enumerate(chain)]
        out.append(" ".join(chain))
    out += [" ".join(text(20) + passage + text(20)) for _ in range(40)]
    out += ["a b c", "A  b, c!", "a b", "", "", "  ", "!!", "12", None, None, " ".join(["one two"] * 300), " ".join(["one two"] * 260), " ".join(["one two"] * 100)]
    ids = list(range(1000, 1000 + len(out)))
    draw.shuffle(ids)
    return list(zip(ids, out))


def test_classes_of_hard_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, node long, key string, rank long").repartition(5)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(df).collect()}
    assert found == classes(rows)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(map(tuple, QUERIES["op5_near_duplicates"](spark, sf).collect())) == classes(docs)


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in [*rows, *rows[:20]]], "doc_id long, text string, node long, key string, rank long").repartition(5)
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.text is not None) == sorted({c for i, c in classes(rows).items() if dict(rows)[i] is not None})
    assert sum(r.text is None for r in kept.collect()) == sum(t is None for _, t in [*rows, *rows[:20]])


def test_odd_rows(spark, odd_documents, empty_documents):
    found = [tuple(r) for r in neardup.near_duplicate_classes(odd_documents).collect()]
    assert len(found) == odd_documents.count()
    assert sorted(c for i, c in found if i in (1, 2)) == [1, 1, 1, 2]  # the row with a null text stands alone
    assert sorted((c for i, c in found if i is None), key=repr) == [None, None]
    kept = neardup.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 2
    assert neardup.near_duplicate_classes(empty_documents).collect() == []
    assert neardup.one_of_each(empty_documents).collect() == []


@pytest.mark.parametrize("changes", [0, 2, 6, 15])
def test_components_agree_with_the_weighted_similarity(changes):
    draw = random.Random(changes)
    words = [f"w{draw.randrange(12)}" for _ in range(300)] + ["x y z"] * 40
    texts = [" ".join(words), varied(draw, words, changes)]
    shingled, counts, bounds = neardup.multisets([t.encode() for t in texts])
    assert counts.max() > 4
    signature = neardup.signatures(shingled, counts, bounds, 4096)
    expected = jaccard(*map(shingles, texts))
    assert abs((signature[0] == signature[1]).mean() - expected) < 0.04
    a, b = ((shingled[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]) for i in (0, 1))
    assert neardup.overlap(a, b) == pytest.approx(expected)


def test_signatures_do_not_hang_on_the_batch():
    texts = [f"text {i} of some words {i * 7} and {i % 3} more ".encode() * (i + 1) for i in range(6)]
    whole = neardup.signatures(*neardup.multisets(texts), 64)
    for i, text in enumerate(texts):
        assert (neardup.signatures(*neardup.multisets([text]), 64)[0] == whole[i]).all()
    assert np.isfinite(whole).all()


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    ranks = spark.createDataFrame([(i, 1000 - i) for i in range(300)], "node long, rank long")
    found = {r.node: r.label.rank for r in neardup.components(spark.createDataFrame(links, "a long, b long"), ranks).collect()}
    assert len(found) == 300
    assert {found[i] for i in range(51)} == {950} and {found[i] for i in range(100, 140)} == {861} and found[201] == found[200] == 799 and found[60] == 940


def test_long_words_that_differ_make_no_class(spark, folder, thue_morse):
    rows = [(1, thue_morse[0]), (2, thue_morse[1]), (3, thue_morse[0]), (4, "a few " + thue_morse[0]), (5, "a few " + thue_morse[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in QUERIES["op5_near_duplicates"](spark, folder(documents=docs)).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
