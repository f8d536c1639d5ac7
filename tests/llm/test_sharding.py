import zlib
from collections import Counter

import numpy as np
import pytest

from trajloom.llm.queries import QUERIES
from trajloom.llm.sharding import Permutation, row_of


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    p = Permutation(n, seed=4)
    places = p.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert (p.row(places) == np.arange(n)).all()
    assert n < 100 or (places != Permutation(n, seed=5).place(np.arange(n))).mean() > 0.9


def check(rows, texts):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    shards = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
        shards.setdefault(r.shard, []).append(r.slot)
        assert row_of(Permutation(len(rows)), 16, r.shard, r.slot) == r.row_number
    sizes = [len(shards.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert sorted(r.row_number for r in rows) == list(range(len(rows)))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    check(rows, docs)
    ordered = sorted(rows, key=lambda r: r.row_number)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in rows)


def test_odd_rows(spark, folder, odd_documents, empty_documents):
    check(QUERIES["op2_sharding"](spark, folder(documents=odd_documents)).collect(), odd_documents.select("doc_id", "text").collect())
    assert QUERIES["op2_sharding"](spark, folder(documents=empty_documents)).collect() == []
