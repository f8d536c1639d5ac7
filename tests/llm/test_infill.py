import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import connection, difference
from trajloom.llm import infill
from trajloom.llm.queries import ORACLES, QUERIES


def brute(key, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_set(members):
    made = infill.BoundarySet(np.array(members, np.int64))
    assert len(made) == len(members)
    some = range(len(members)) if len(members) < 3000 else [0, 1, 63, 64, len(members) // 2, len(members) - 2, len(members) - 1]
    assert [made.select(k) for k in some] == [members[k] for k in some]
    return {type(c) for c in made.containers}


def test_containers_of_each_kind():
    assert check_set(list(range(5, 9000, 7))) == {infill.ArrayContainer}
    assert check_set(list(range(1, 65536, 2))) == {infill.BitmapContainer}
    assert check_set(list(range(300, 65000))) == {infill.RunContainer}
    mixed = [*range(3, 400, 11), *range(65536, 131072, 3), *range(5 * 65536 + 7, 6 * 65536), 2**31 - 2]
    assert check_set(mixed) == {infill.ArrayContainer, infill.BitmapContainer, infill.RunContainer}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**31 - 1)), st.integers(0, 200_000), st.integers(1, 3000))
def test_any_set(members, start, run):
    check_set(sorted(members | set(range(start, start + run))))


@settings(max_examples=300, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(alphabet=st.sampled_from("ab\n é漢<PSM>\r")), st.sampled_from([0, 40, 100]), st.sampled_from([0, 50, 100]))
def test_cuts(key, text, rate, suffix_first):
    coded = text.encode()
    ends = infill.line_ends(coded)
    got = infill.cut(coded, ends, infill.draws(7, key), rate, suffix_first)
    assert (len(ends), *got[:3], got[3].decode()) == brute(key, text, rate, suffix_first)


def test_texts_come_back(spark):
    rows = [(k, ("<S", "a<", "\n<P", "x>\n")[k % 4] * (k % 9) + "é\n" * (k % 5)) for k in range(200)]
    rows += [(1000, "\n" * 200_000), (1001, "line é\n" * 60_000), (1002, "a" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'f' AS form")
    made = infill.fill_in_middle(df, "doc_id", ["doc_id", "text"]).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    found = {r.doc_id: r for r in made.collect()}
    assert len(found) == len(rows) and {r.form for r in found.values()} == {"plain", "psm", "spm"}
    for key, text in rows:
        r = found[key]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(key, text) and r.back == text


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES["op13_fill_in_middle"](spark, sf), connection(sf), ORACLES["op13_fill_in_middle"]) is None


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    rows = QUERIES["op13_fill_in_middle"](spark, folder(documents=odd_documents)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in odd_documents.collect():
        *columns, output = brute(r.doc_id, r.text)
        want.append((r.doc_id, *columns, sha(output), sha(r.text or "")))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert QUERIES["op13_fill_in_middle"](spark, folder(documents=empty_documents)).collect() == []


@pytest.mark.parametrize("seed", [0, 7, 8])
def test_draws_hang_on_seed_and_key(seed):
    assert infill.draws(seed, 3) != infill.draws(seed + 1, 3) != infill.draws(seed + 1, 4)
