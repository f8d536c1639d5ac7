import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajloom.llm import quality
from trajloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


texts = st.text(alphabet=st.sampled_from("ab \n\t\u000b é#|!.A9"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_sums(many):
    found = quality.measure([t.encode() for t in many])
    assert [tuple(int(found.sums[c][i]) for c in quality.SUMS) for i in range(len(many))] == [brute(t) for t in many]
    for i, text in enumerate(many):
        alone = quality.measure([text.encode()])
        own = slice(found.bounds[i], found.bounds[i + 1])
        assert alone.kinds.tolist() == found.kinds[own].tolist()
        assert [w > 0 for w in found.line_words[own]] == [bool(WORD.search(x)) for x in text.split("\n")]


def test_long_texts_are_read_whole(monkeypatch):
    text = ("ab cd\né ef gh! " * 300 + "x" * 50 + "\n") * 3
    whole = quality.measure([text.encode()])
    monkeypatch.setattr(quality, "PART_BYTES", 11)
    parts = quality.measure([text.encode()])
    assert tuple(int(whole.sums[c][0]) for c in quality.SUMS) == brute(text) == tuple(int(parts.sums[c][0]) for c in quality.SUMS)
    assert whole.kinds.tolist() == parts.kinds.tolist()


def test_keys_beyond_a_long_stay_exact():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 3, 500) * (2**40) + draw.integers(0, 2, 500) for _ in range(4)]
    key = quality.joint_key(columns)
    assert len(set(key.tolist())) == len(set(zip(*(c.tolist() for c in columns))))


def path_score(field, kinds, labels):
    return sum(field.kinds[k] for k, b in zip(kinds, labels) if b) + sum(field.after[a][b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_decoding_finds_the_best_sequence(seed):
    draw = np.random.default_rng(seed)
    field = quality.Field(draw.normal(0, 2, quality.KINDS), draw.normal(0, 2, (2, 2)).tolist())
    kinds = draw.integers(0, quality.KINDS, seed % 9)
    labels = field.decode(kinds).tolist()
    best = max((path_score(field, kinds, p) for p in itertools.product([0, 1], repeat=len(kinds))), default=0)
    assert len(labels) == len(kinds) and path_score(field, kinds, list(map(int, labels))) == pytest.approx(best)


def test_ties_are_content():
    assert not quality.NEUTRAL.decode(np.zeros(5, int)).any()


def test_fit_is_the_optimum():
    draw = np.random.default_rng(5)
    kinds = draw.integers(0, quality.KINDS, 400)
    codes = np.unique(((kinds * 3 + draw.integers(0, 3, 400)) * 3 + draw.integers(0, 3, 400)) * 2 + draw.integers(0, 2, 400))
    counts = draw.integers(1, 50, len(codes)).astype(float)
    field = quality.fit_counts(codes, counts)
    x, y = quality._design(codes)
    near = field.after[1][1] - field.after[0][1] - field.after[1][0]
    weights = np.append(np.linalg.lstsq(quality._kind_features(np.arange(quality.KINDS)), field.kinds, rcond=None)[0], [near, field.after[0][1], field.after[1][0]])
    slope = x.T @ (counts * (1 / (1 + np.exp(-x @ weights)) - y)) + quality.PENALTY * weights
    assert np.abs(slope).max() < 1e-2  # the loss is convex
    # The conditional odds of a label by the field's own scores are those that were fitted.
    before, after, kind = 1, 0, 3
    odds = path_score(field, [0, kind, 0], [before, 1, after]) - path_score(field, [0, kind, 0], [before, 0, after])
    assert odds == pytest.approx(float(quality._design(np.array([((kind * 3 + before) * 3 + after) * 2]))[0][0] @ weights))


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = quality.rule_documents(docs.select("doc_id", "text"), labels.where(~held), ["doc_id"])
    good = {r.doc_id: r.quality for r in labels.collect()}
    seen = [(r.kept, good[r.doc_id]) for r in rows.collect() if r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and not r.base_failed]
    assert len(seen) > 500
    assert np.mean([k for k, g in seen if g]) > 0.99 and np.mean([k for k, g in seen if not g]) < 0.05


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_quality_rules"](spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(truth[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_content_runs(spark):
    field = quality.Field(np.where(np.arange(quality.KINDS) // (quality.KINDS // 4) > 0, 5.0, -5.0), [[0.0, 0.0], [0.0, 0.0]])
    text = "Clean line here.\n\n*** | menu\nMore text\n\nand more\n   \n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "| |"), (4, "\n\n")], "doc_id long, text string")
    rows = quality.judged(quality.measured(df, ["doc_id", "text"]), field, ["doc_id", "text"])
    found = {r.doc_id: r for r in rows.withColumn("kept_text", quality.content_text(F.col("text"), F.col("content"))).collect()}
    assert [tuple(x) for x in found[1].content] == [(0, 1), (3, 6)]
    assert found[1].kept_text == "Clean line here.\nMore text\n\nand more" and found[1].content_share == pytest.approx(7 / 10)
    assert [(found[i].content_share, found[i].content, found[i].retained, found[i].kept_text) for i in (2, 3, 4)] == [(0.0, [], False, "")] * 3


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (7, 0, 1), (1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = QUERIES["op12_quality_rules"](spark, folder(documents=odd_documents, labels=labels)).collect()
    key = lambda r: str(tuple(r))
    sums = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=key)
    assert sums == sorted(((r.doc_id, *brute(r.text)) for r in odd_documents.collect()), key=key)
    known = {r.doc_id: r.good for r in quality.labelled(quality.measured(odd_documents, ["doc_id"]), labels).collect()}
    assert known == {6: True, 7: False}
    assert QUERIES["op12_quality_rules"](spark, folder(documents=empty_documents, labels=labels)).collect() == []
    unlabelled = QUERIES["op12_quality_rules"](spark, folder(documents=odd_documents, labels=labels.limit(0))).collect()
    assert all(r.kept == (not r.base_failed) for r in unlabelled)


def test_result_does_not_hang_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    first, second = (sorted(map(str, quality.rule_documents(docs.repartition(n), labels, ["doc_id"]).collect())) for n in (1, 7))
    assert first == second
