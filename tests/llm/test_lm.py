import math
from collections import Counter

import pytest
from brute import words

from trajloom.llm import ngram_lm
from trajloom.llm.queries import QUERIES


def expected(rows, order=2, alpha=0.4, min_count=2):
    counts = [Counter() for _ in range(order + 1)]
    for _, text in rows:
        w = words(text)
        for k in range(1, order + 1):
            counts[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total = sum(counts[1].values())

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[1][gram] / total)
        if counts[len(gram)][gram] >= min_count:
            return math.log(counts[len(gram)][gram] / counts[len(gram) - 1][gram[:-1]])
        return math.log(alpha) + score(gram[1:])

    out = []
    for doc_id, text in rows:
        w = words(text)
        total_score = sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))
        out.append((doc_id, len(w), total_score))
    return sorted(out, key=repr)


def check(rows, wanted):
    rows = sorted(((r.doc_id, r.n_words, r.log_score, r.mean_score) for r in rows), key=lambda r: repr(r[:2]))
    wanted = sorted(wanted, key=lambda r: repr(r[:2]))
    assert [r[:2] for r in rows] == [r[:2] for r in wanted]
    for (_, n, score, mean), (_, _, own) in zip(rows, wanted):
        assert score == pytest.approx(own, rel=1e-9, abs=1e-9)
        assert mean == (pytest.approx(own / n) if n else None)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op6_ngram_scores"](spark, sf).collect(), expected(docs, 3))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_and_many_blocks(spark, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 200)
    rows = [(i, " ".join(f"w{(i * j * j) % 11}" for j in range(i % 40))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(ngram_lm.score_documents(df, order).collect(), expected(rows, order))


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    check(QUERIES["op6_ngram_scores"](spark, folder(documents=odd_documents)).collect(), expected(rows, 3))
    assert QUERIES["op6_ngram_scores"](spark, folder(documents=empty_documents)).collect() == []


def test_the_query_gives_bigram_scores_too(spark, folder, odd_documents):
    for path in ("/root/testdata/sf0.001", folder(documents=odd_documents)):
        docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
        rows = QUERIES["op6_ngram_scores"](spark, path)
        check(rows.selectExpr("doc_id", "n_words", "log_score_2 AS log_score", "mean_score_2 AS mean_score").collect(), expected(docs, 2))


def test_long_words_that_differ_are_other_words(spark, folder, thue_morse):
    rows = [(1, thue_morse[0]), (2, thue_morse[1]), (3, thue_morse[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(QUERIES["op6_ngram_scores"](spark, folder(documents=docs)).collect(), expected(rows, 3))
