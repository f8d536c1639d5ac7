import re
from collections import Counter, defaultdict

import pytest

from compare import connection, difference
from trajloom.llm import divergence
from trajloom.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    """Rows (lang, source, text) to the audit, with whole numbers only."""
    bags = [(g or "", s or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in bags}:
        documents, total, groups = Counter(), Counter(), defaultdict(Counter)
        for g, s, bag in bags:
            if g == lang:
                documents.update(bag.keys())
                total.update(bag)
                groups[s].update(bag)
        kept = [t for t, n in documents.items() if n >= least]

        def share(bag, t):
            return 1 + 10**9 * (bag[t] + 2) // (sum(bag[k] for k in kept) + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for s, bag in groups.items():
            pairs = [(o, sum(apart(share(bag, t), share(other, t)) for t in kept)) for o, other in groups.items() if o != s]
            terms = [(t, apart(share(bag, t), share(total, t))) for t in kept if bag[t] and share(bag, t) > share(total, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    words = "alpha Beta gamma delta ÉTÉ 漢字 z".split()
    texts = [" ".join(words[(i * k + k // 3) % 7] + ("'" if i % 2 else "-") + words[(i + k) % 7] for i in range(k % 9)) for k in range(120)]
    made = [(("en", "de", None)[k % 3], f"s{k % 11}" if k % 13 else None, t) for k, t in enumerate(texts)]
    return [*made, ("en", "silent", None), ("en", "silent", "12 34"), ("xx", "a", "rare"), ("xx", "b", ""), ("one", "alone", "only word")]


def audited(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    return sorted(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("blocks", [(64, 4096), (3, 2), (1, 1)])
def test_any_cube_gives_the_same_sums(spark, rows, blocks):
    got = audited(spark, rows, least_documents=3, top=4, group_block=blocks[0], term_block=blocks[1])
    assert got == brute(rows, 3, 4)
    assert ("xx", "a", "pair", "b", 0, 1) in got  # a language without kept terms
    assert not [r for r in got if r[0] == "one"]


def test_parts_of_long_texts(monkeypatch):
    assert divergence.count_terms(b"A b'a c1A") == Counter({b"a": 3, b"b": 1, b"c": 1})
    long = b"word another " * 50
    whole = divergence.count_terms(long)
    monkeypatch.setattr(divergence, "PART_BYTES", 7)
    assert divergence.count_terms(long) == whole == Counter({b"word": 50, b"another": 50})
    assert divergence.count_terms(b"") == Counter() == divergence.count_terms(b"...")


def test_great_counts_stay_exact(spark):
    n, total, terms = 9 * 10**15, 10**16 + 1, 10**7
    row = spark.sql(f"SELECT {n}L AS n, {total}L AS total, {terms}L AS terms")
    from pyspark.sql import functions as F

    share = row.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert share == 1 + 10**9 * (n + 2) // (total + 2 * terms)
    p, q = 10**9 + 1, 3
    assert spark.sql(f"SELECT {p}L AS p, {q}L AS q").select(divergence.divergence(F.col("p"), F.col("q"))).first()[0] == (p - q) ** 2 // (p + q)


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES["op11_source_divergence"](spark, sf), connection(sf), ORACLES["op11_source_divergence"]) is None


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    got = QUERIES["op11_source_divergence"](spark, folder(documents=odd_documents))
    rows = [(r.lang, r.source, r.text) for r in odd_documents.collect()]
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, 10, 10)
    assert QUERIES["op11_source_divergence"](spark, folder(documents=empty_documents)).collect() == []
    many = odd_documents.unionAll(odd_documents).unionAll(odd_documents).unionAll(odd_documents).unionAll(odd_documents)
    rows = [(r.lang, r.source, r.text) for r in many.collect()]
    got = divergence.audit(many.selectExpr("*", "1 AS block", "2 AS total", "3 AS term"))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, 10, 10)
