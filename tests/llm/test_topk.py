import math

import numpy as np
import pandas as pd
import pytest
from compare import connection, difference

from trajloom.llm import topk
from trajloom.llm.queries import ORACLES, QUERIES


def expected(rows, k=5):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ints:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def check(spark, folder, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score long, id long, block long").repartition(4)
    found = QUERIES["op7_exact_topk"](spark, folder(embeddings=df))
    assert sorted(map(tuple, found.collect())) == expected([(r[0], r[1]) for r in rows])


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op7_exact_topk"](spark, sf), connection(sf), ORACLES["op7_exact_topk"]) is None


def test_ties_go_to_smaller_ids(spark, folder):
    check(spark, folder, [(i, [0.5, 0.25], 1, 1, 1, 1) for i in range(130)])


def test_odd_vectors(spark, folder):
    extra = (1, 2, 3, 4)
    rows = [(0, [1.0, -2.0]), (50, None), (100, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (150, [0.1, 0.2]), (6, [-3.0, 2.5]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [1e-9, -1e-9])]
    check(spark, folder, [(*r, *extra) for r in rows])
    check(spark, folder, [])
    check(spark, folder, [(50, [1.0], *extra)])


def test_great_numbers_stay_exact(spark, folder):
    check(spark, folder, [(i, [6e6 + i, 3.0, -6e6], 1, 2, 3, 4) for i in range(60)])
    check(spark, folder, [(2**63 - 1 - i, [1.0, float(i)], 1, 2, 3, 4) for i in range(60)])


def test_a_score_beyond_a_long_names_the_ids():
    blocks = pd.DataFrame({"ids": [[7, 8]], "rows": [[np.array([1e7, 1e7]), np.array([3e7, 0.0])]]})
    queries = pd.DataFrame({"query_id": [50], "query_key": [0], "v": [np.array([1e12, 1e12])]})
    with pytest.raises(OverflowError, match="query 50 and vector [78]"):
        topk.search_group(queries, blocks, 2)


def test_pruning_changes_nothing(monkeypatch):
    draw = np.random.default_rng(2)
    vectors = draw.normal(0, 0.3, (600, 8)) * draw.choice([0.1, 1, 3], (600, 1))
    blocks = pd.DataFrame({"ids": [list(range(a, a + 20)) for a in range(0, 600, 20)], "rows": [list(vectors[a : a + 20]) for a in range(0, 600, 20)]})
    queries = pd.DataFrame({"query_id": range(0, 600, 50), "query_key": range(12), "v": list(vectors[::50])})
    found = topk.search_group(queries, blocks, 5)
    found["rank"] = found.groupby("query_id").cumcount() + 1
    assert sorted(found[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == expected(list(enumerate(vectors.tolist())))


@pytest.mark.parametrize("size", [1, 7])
def test_small_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    rows = [(i, [math.sin(i), math.cos(3 * i)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, found)) == expected(rows)
