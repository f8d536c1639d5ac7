import re

import corpus_pipeline
import pyarrow as pa
import pytest
from brute import classes
from pyspark.sql import functions as F
from test_decontamination import expected as leaks
from test_token_ids import check_packing

from trajloom.llm import common, packing
from trajloom.operators.store import store


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    firsts = set(classes(kept).values())
    kept = [(i, t) for i, t in kept if i in firsts]
    leaked = {i for i, _ in leaks(kept, items)}
    check_packing(corpus_pipeline.run(spark, sf).collect(), [(i, t) for i, t in kept if i not in leaked])


def test_stages_keep_columns_of_odd_rows(spark, folder, odd_documents, empty_documents):
    items = spark.createDataFrame([(1, "une phrase courte mais claire")], "item_id long, text string")
    for docs in (odd_documents, empty_documents):
        sf = folder(documents=docs, benchmark=items)
        df = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, sf)
            assert after.columns == docs.columns
            df = after
        assert not df.where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").count()
        assert {r.doc_id for r in df.collect()} == ({1, 6, 7, 8, 9} if docs is odd_documents else set())
        corpus_pipeline.run(spark, sf).collect()


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"]


def batch_sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])


def test_batches_are_bounded_by_bytes(spark):
    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    sizes = [r.n for r in common.store_by_batches(long.mapInArrow(batch_sizes, "n long"), "sizes").collect()]
    assert sum(sizes) == 4000 and max(sizes) * 4000 < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_SETTING, None) is None
    with pytest.raises(ZeroDivisionError), common.bounded_batches(spark):
        1 / 0
    assert spark.conf.get(common.BATCH_SETTING, None) is None
    spark.conf.set(common.BATCH_SETTING, "1000000")
    try:
        with common.bounded_batches(spark):
            assert spark.conf.get(common.BATCH_SETTING) == "1000000"
        assert spark.conf.get(common.BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_stages_write_by_bounded_batches(spark, monkeypatch):
    seen = []

    def noted(df, name):
        seen.append((re.sub("^stage-.*", "stage", name), df.sparkSession.conf.get(common.BATCH_SETTING, None)))
        return store(df, name)

    monkeypatch.setattr(common, "store", noted)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"stage", "sketches", "bags", "compared", "tokens", "placed"} <= {name for name, _ in seen}
    assert {limit for _, limit in seen} == {str(common.BATCH_BYTES)}


def test_ranks_start_from_rows_of_the_jvm(spark):
    sizes = spark.createDataFrame([(i, 5 + i % 3) for i in range(9)], "_row long, n_tokens long")
    places, _, _ = packing.place_rows(store(sizes, "sizes"))
    plan = places._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan and "ExistingRDD" not in plan
