"""Physical plans of the core queries."""

import re

import pytest

from trajloom.operators.batching import assign_batches
from trajloom.operators.enrich import enrich, with_loss
from trajloom.operators.metrics import metrics
from trajloom.operators.policy import completion_tokens
from trajloom.operators.replay import replay_pairs
from trajloom.operators.store import store
from trajloom.operators.tokenise import build_vocabulary, encode
from trajloom.plans.queries import QUERIES
from trajloom.sources.tables import numeric_trajectories, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_of_all_queries(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "BatchEvalPython" not in text
    # What leaves the JVM: user functions, and token lists on their way through a dictionary.
    if not name.startswith(("user_", "udtf_", "source_by_name", "encode", "truncat", "labels_mask", "completion_span", "pad_batches", "preview", "weighted")):
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_losses_need_no_shuffle_and_few_columns(spark):
    rows = with_loss(enrich(numeric_trajectories(spark, SF)))
    text = plan(rows.select("loss"))
    assert "Exchange" not in text
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "l_extendedprice" not in read and "l_shipdate" not in read


def test_metrics_combine_before_the_shuffle(spark):
    text = plan(metrics(with_loss(enrich(numeric_trajectories(spark, SF))), ["origin_label"]))
    assert text.count("Exchange") == 1 and "partial_avg" in text


def test_filters_reach_the_scan(spark):
    text = plan(table(spark, SF, "lineitem").where("l_returnflag = 'R'").select("l_tax"))
    assert "EqualTo(l_returnflag,R)" in text


def test_numbering_has_no_window_over_all_rows(spark):
    rows = assign_batches(table(spark, SF, "events"), "event_id")
    text = plan(rows)
    assert "SinglePartition" not in text
    assert re.search(r"row_number\(\) windowspecdefinition\(epoch#\d+, _bucket#\d+", text)


def test_encoding_shuffles_texts_not_tokens(spark):
    texts = table(spark, SF, "documents").select("doc_id", "text")
    words = store(build_vocabulary(texts, ["text"]), "words")
    # A small vocabulary: no shuffle, no exploded tokens.
    text = plan(encode(texts, ["text"], words))
    assert "Exchange" not in text and "Generate" not in text and "ArrowEvalPython" in text
    # A large one: tokens are shuffled, and the texts once, in the join back.
    text = plan(encode(texts, ["text"], words, broadcast_bytes=0))
    wide = [line for line in text.splitlines() if "FileScan" in line and "_row" in line and "doc_id" in line]
    assert len(wide) == 1


def test_pairs_shuffle_the_texts_once(spark):
    # They are placed and written once; what is left moves the edges of the ranges only.
    text = plan(replay_pairs(table(spark, SF, "conversations"), ranges=3))
    assert "conversations.parquet" not in text


def test_exploded_rows_carry_no_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], [1, 2])], "traj_id int, input_ids array<int>, labels array<int>")
    out = completion_tokens(df, ["traj_id"])
    assert dict(out.dtypes) == {"traj_id": "int", "pos": "int", "prev": "int", "token": "int"}
    assert "Generate" in plan(out) and "false, [pos#" in plan(out)
