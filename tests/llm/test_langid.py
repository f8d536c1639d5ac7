import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from trajloom.llm import langid
from trajloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    first, second = (sorted(map(tuple, QUERIES["op8_language_id"](spark, folder(documents=d)).collect())) for d in (docs, spoiled))
    assert first == second


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    rows = QUERIES["op8_language_id"](spark, folder(documents=odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    by_id = Counter((r.doc_id, r.lang_pred == "und") for r in rows)
    assert by_id[(3, True)] == by_id[(4, True)] == by_id[(5, True)] == by_id[(2, True)] == by_id[(2, False)] == by_id[(None, True)] == 1
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert QUERIES["op8_language_id"](spark, folder(documents=empty_documents)).collect() == []
    unlabelled = odd_documents.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in QUERIES["op8_language_id"](spark, folder(documents=unlabelled)).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("languages", [1, 2, 3, 7, 8, 40])
def test_codewords_differ(languages):
    code = langid.codewords(languages)
    assert len(np.unique(code, axis=0)) == languages or languages == 1
    assert (np.abs(code.sum(0)) < languages).all()


def test_trigrams_of_each_text_alone():
    texts = [b"abc", b"", b"x", b"The end"]
    buckets, bounds = langid.trigram_buckets(texts)
    for i, text in enumerate(texts):
        alone, _ = langid.trigram_buckets([text]) if text else (np.zeros(0), None)
        assert buckets[bounds[i] : bounds[i + 1]].tolist() == alone.tolist() and len(alone) == len(text)


def test_parts_of_long_texts(monkeypatch):
    texts = [b"ab " * 100, b"", b"xyz", b"q" * 64, b"r" * 65, b"The end of it"]
    whole, bounds = langid.trigram_buckets(texts)
    monkeypatch.setattr(langid, "PIECE_BYTES", 64)
    found = {}
    for first, held in langid.runs(texts):
        buckets, cuts = langid.trigram_buckets(held, padded=True)
        for k in range(len(held)):
            found.setdefault(first + k, []).extend(buckets[cuts[k] : cuts[k + 1]].tolist())
    assert [found[i] for i in range(len(texts))] == [whole[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def plain_model(rows):
    """Counts, codewords, log odds and trust, one number at a time."""
    fold = lambda t: "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), t))

    def buckets(text):
        raw = (" " + fold(text) + " ").encode()
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> (32 - langid.BUCKET_BITS) for i in range(len(raw) - 2)]

    languages = sorted({g for g, _ in rows})
    counts = {g: Counter() for g in languages}
    for g, t in rows:
        counts[g].update(buckets(t))
    total = {g: sum(counts[g].values()) for g in languages}
    code = langid.codewords(len(languages))
    floor = langid.SMOOTHING / (sum(total.values()) / len(languages))

    def odds(bit, bucket):
        share = {g: counts[g][bucket] / max(total[g], 1) for g in languages}
        sides = [[share[g] for i, g in enumerate(languages) if code[i, bit] == side] for side in (1, -1)]
        return math.log(sum(sides[0]) / len(sides[0]) + floor) - math.log(sum(sides[1]) / len(sides[1]) + floor)

    bits = range(code.shape[1])
    trust = []
    for i, g in enumerate(languages):
        known = [max(code[i, b] * sum(n / total[g] * odds(b, u) for u, n in counts[g].items()), 1e-6) for b in bits]
        trust.append([k / sum(known) for k in known])

    def decode(text):
        own = buckets(text)
        margins = [sum(odds(b, u) for u in own) / max(len(own), 1) for b in bits]
        loss = [sum(trust[i][b] * math.log1p(math.exp(-4 * margins[b] * code[i, b])) for b in bits) for i in range(len(languages))]
        best, second = sorted(range(len(languages)), key=lambda i: loss[i])[:2]
        return languages[best], 1 - loss[best] / loss[second]

    return decode


def test_fit_and_decode_against_a_plain_version(spark, folder):
    rows = [("en", "the house and The tree"), ("de", "das Haus und der Baum"), ("fr", "la maison et l'arbre é"), ("en", "that thing there"), ("de", "nicht die Stadt"), ("xx", "zzz qq zqz")] * 3
    docs = spark.createDataFrame([(i, t, g, "s") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    learned = [r for i, r in enumerate(rows) if zlib.crc32(str(i).encode()) % 4 != 2]
    decode = plain_model(learned)
    found = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, folder(documents=docs)).collect()}
    for i, (_, text) in enumerate(rows):
        lang, score = decode(text)
        assert found[i].lang_pred == lang and found[i].score == pytest.approx(score, abs=1e-5)


def traced_peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_does_not_grow_with_bits():
    languages = 40
    code = langid.codewords(languages)
    draw = np.random.default_rng(1)
    weights = draw.normal(size=(code.shape[1], 1 << langid.BUCKET_BITS)).astype(np.float32)
    model = langid.Model([str(i) for i in range(languages)], code, weights, np.full(code.shape, 1 / code.shape[1]))
    texts = [b"a text of some forty letters, more or less"] * 20_000
    found = {}
    # At once, the weights would take 180 MB and the losses 350 MB for each array.
    assert traced_peak(lambda: found.update(margins=model.margins(texts))) < 100
    assert traced_peak(lambda: found.update(decoded=model.decode(found["margins"]))) < 60
    best, lead = found["decoded"]
    alone = model.decode(model.margins(texts[:1]))
    assert set(best.tolist()) == set(alone[0].tolist()) and np.ptp(lead) == 0 and lead[0] == pytest.approx(alone[1][0])
