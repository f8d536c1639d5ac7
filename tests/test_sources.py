"""Readers, column checks, splits and the whole job from file to training set."""

import json

import pytest

from trajloom.operators.enrich import enrich
from trajloom.operators.policy import fit_policy
from trajloom.operators.store import new_path, shared_dir, store
from trajloom.options import BatchOptions, LossOptions, TokenOptions
from trajloom.plans.training_run import evaluate, prepare_training_set, with_ids
from trajloom.sources.writer import save_metrics
from trajloom.sources.reader import (
    check_tokenised,
    file_format,
    prune,
    read_json,
    read_trajectories,
)

ROW = {
    "prompt": "Name a river in Peru.",
    "response": "The Ucayali\nis one of them; \\n is no line end.",
    "nll_seq": 17.25,
    "advantage": 1.0,
    "origin_label": "positive",
}


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


@pytest.mark.parametrize(
    "path, kind",
    [
        ("a/b.json", "json"), ("a/b.jsonl", "json"), ("a/b.json.gz", "json"), ("a/b.parquet", "parquet"),
        ("a/b.json.parquet", "parquet"), ("a/b.parquet/part-0", "parquet"), ("a/b", None),
    ],
)
def test_format_by_path(path, kind):
    assert file_format(path) == kind


def test_json_lines(spark, tmp_path):
    a = write_lines(tmp_path / "a.jsonl", [ROW, {**ROW, "nll_seq": 2, "advantage": None}])
    b = write_lines(tmp_path / "b.json", [{**ROW, "nll_seq": 3}])
    df = read_trajectories(spark, f"{a}||{b}")["train"]
    assert dict(df.dtypes)["nll_seq"] == "double"
    rows = df.collect()
    assert sorted(r.nll_seq for r in rows) == [2.0, 3.0, 17.25]
    assert rows[0].response == ROW["response"]


def test_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([ROW, ROW], indent=1))
    assert read_trajectories(spark, str(path))["train"].count() == 2


def test_json_whole_numbers_widen(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{**ROW, "nll_seq": 1}, {**ROW, "nll_seq": 1.5}])
    assert sorted(r.nll_seq for r in read_json(spark, [path]).collect()) == [1.0, 1.5]


def test_columns_of_any_row_are_found(spark, tmp_path):
    plain = {k: v for k, v in ROW.items() if k not in ("origin_label", "advantage")}
    late = [{**ROW, "origin_label": "negative", "advantage": -2}] * 5
    a = write_lines(tmp_path / "a.jsonl", [plain] * 1500 + late[:1])
    b = write_lines(tmp_path / "b.jsonl", late)
    rows = enrich(read_trajectories(spark, f"{a}||{b}")["train"])
    assert rows.where("origin_is_negative = 1 AND advantage = -2").count() == 6
    numeric = write_lines(tmp_path / "c.jsonl", [{**ROW, "origin_label": None}] * 1200 + [{**ROW, "origin_label": 1}] * 9)
    assert enrich(read_trajectories(spark, numeric)["train"]).where("origin_is_negative = 1").count() == 9


def test_long_ids_stay_whole(spark, tmp_path):
    ids = [2**53 + i for i in range(4)]
    path = write_lines(tmp_path / "a.jsonl", [{**ROW, "traj_id": i, "nll_seq": 3} for i in ids])
    df = read_json(spark, [path])
    assert sorted(r.traj_id for r in df.collect()) == ids and dict(df.dtypes)["nll_seq"] == "double"


def test_json_numeric_labels_mean_the_flag(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{**ROW, "origin_label": v} for v in (1, 0, None)])
    flags = [r.origin_is_negative for r in enrich(read_trajectories(spark, path)["train"]).collect()]
    assert sorted(flags) == [0.0, 0.0, 1.0]


def test_broken_json_fails(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps(ROW) + "\n{broken\n")
    schema = read_json(spark, [write_lines(tmp_path / "b.jsonl", [ROW])]).schema
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json(spark, [str(path)], schema).collect()


def test_missing_columns(spark, tmp_path, caplog):
    path = write_lines(tmp_path / "a.jsonl", [{"prompt": "p", "response": "r"}])
    with pytest.raises(ValueError, match="a.jsonl.*nll_seq"):
        read_trajectories(spark, path)
    path = write_lines(tmp_path / "b.jsonl", [{"prompt": "p", "response": "r", "nll_seq": 1.0}])
    df = read_trajectories(spark, path)["train"]
    assert "counts as positive" in caplog.text
    assert enrich(df).first().origin_is_negative == 0.0
    with pytest.raises(RuntimeError, match="lost"):
        check_tokenised(df.drop("nll_seq"))


def test_parquet_list_aligns_columns(spark, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.createDataFrame([("p", "r", 1.0)], "prompt string, response string, nll_seq double").write.parquet(a)
    spark.createDataFrame(
        [(2.0, "q", "s", "negative")], "nll_seq double, prompt string, response string, origin_label string"
    ).write.parquet(b)
    rows = read_trajectories(spark, f"{a}||{b}")["train"].collect()
    assert {(r.prompt, r.nll_seq, r.origin_label) for r in rows} == {("p", 1.0, None), ("q", 2.0, "negative")}
    assert read_trajectories(spark, f"{a}||{a}")["train"].count() == 2


def test_mixed_formats_are_refused(spark):
    with pytest.raises(ValueError, match="one format"):
        read_trajectories(spark, "a.json||b.parquet")


@pytest.mark.parametrize("layout", ["files", "folders", "partitions", "other words"])
def test_directory_splits(spark, tmp_path, layout):
    root = tmp_path / "my train data" / "train"
    names = {
        "files": ("train-00000.jsonl", "test-00000.jsonl"),
        "folders": ("train/a.jsonl", "test/a.jsonl"),
        "partitions": ("split=train/a.jsonl", "split=test/a.jsonl"),
        "other words": ("data/training_0.jsonl", "data/my-eval.jsonl"),
    }[layout]
    for name, rows in zip(names, ([ROW, ROW], [ROW])):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        write_lines(root / name, rows)
    write_lines(root / "validation.jsonl", [ROW])
    splits = read_trajectories(spark, str(root))
    assert {name: df.count() for name, df in splits.items()} == {"train": 2, "test": 1}
    assert splits["train"].columns == ["advantage", "nll_seq", "origin_label", "prompt", "response"]


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_cards_are_not_read(spark, tmp_path, kind):
    root = tmp_path / "set + card"
    rows = spark.createDataFrame([("p", "r", 1.0)] * 4, "prompt string, response string, nll_seq double")
    getattr(rows.write, kind)(str(root / "data"))
    (root / "README.md").write_text("# card")
    (root / "info.json").write_text('{"description": "x"}')
    (root / "dataset_info.json").write_text('{"description": "x", "nll_seq": 7}')
    splits = read_trajectories(spark, str(root))
    assert list(splits) == ["train"] and splits["train"].count() == 4
    assert "description" not in splits["train"].columns


def test_parquet_folder_with_two_schemas(spark, tmp_path):
    path = str(tmp_path / "mixed")
    spark.createDataFrame([("p", "r", 1.0)], "prompt string, response string, nll_seq double").write.parquet(path)
    more = spark.createDataFrame([("p", "r", 1.0, "negative")], "prompt string, response string, nll_seq double, origin_label string")
    more.write.mode("append").parquet(path)
    assert enrich(read_trajectories(spark, path)["train"]).where("origin_is_negative = 1").count() == 1
    (tmp_path / "a.parquet").mkdir()
    listed = str(tmp_path / "a.parquet" / "x")
    more.write.parquet(listed)
    spark.createDataFrame([("p", "r", 1.0)], "prompt string, response string, nll_seq double").write.mode("append").parquet(listed)
    assert read_trajectories(spark, listed)["train"].where("origin_label = 'negative'").count() == 1


def test_folder_without_data_or_of_two_kinds(spark, tmp_path):
    (tmp_path / "README.md").write_text("# card")
    with pytest.raises(ValueError, match="JSON or parquet"):
        read_trajectories(spark, str(tmp_path))


def test_ids_hang_on_the_rows_alone(spark):
    df = spark.createDataFrame([(f"p{i % 7}", i % 3) for i in range(50)], "prompt string, n int")
    first, second = (sorted(map(tuple, with_ids(df.repartition(p)).collect())) for p in (1, 6))
    assert first == second and sorted(r[-1] for r in first) == list(range(50))


@pytest.mark.parametrize("lenient", [False, True])
def test_text_that_is_no_number_fails_whatever_is_read(spark, lenient):
    df = spark.createDataFrame([("abc",), ("1.5",)], "nll_seq string")
    with pytest.raises(Exception, match="not a number"):
        enrich(df, LossOptions(require_old_nll=not lenient)).count()


def test_split_filter_skips_the_other_files(spark, tmp_path):
    path = str(tmp_path / "set")
    spark.range(100).selectExpr(
        "id", "1.0D as nll_seq", "if(id < 90, 'train', 'test') as split"
    ).write.partitionBy("split").parquet(path)
    test = read_trajectories(spark, path)["test"]
    assert test.count() == 10
    test.collect()
    scan = test._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() == 10


def test_directory_without_splits_is_training_data(spark, tmp_path):
    path = str(tmp_path / "trajectories")
    spark.createDataFrame([("p", "r", 1.0)], "prompt string, response string, nll_seq double").write.parquet(path)
    splits = read_trajectories(spark, path)
    assert list(splits) == ["train"] and splits["train"].count() == 1


def test_prune_reads_only_kept_columns(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    spark.createDataFrame(
        [("p", "r", 1.0, "x" * 50)], "prompt string, response string, nll_seq double, junk string"
    ).write.parquet(path)
    df = prune(spark.read.parquet(path), [])
    assert "junk" not in df._jdf.queryExecution().executedPlan().toString()


def test_store_uses_the_shared_folder(spark):
    df = store(spark.range(5), "numbers")
    assert all(shared_dir(spark) in f.replace("file://", "") for f in df.inputFiles())
    assert df.count() == 5 and new_path(spark, "x") != new_path(spark, "x")


def test_stored_tables_can_be_removed(spark, monkeypatch, tmp_path):
    import trajloom.operators.store as module

    monkeypatch.setattr(module, "shared_dir", lambda _: str(tmp_path))
    (tmp_path / "trajloom" / "other-app").mkdir(parents=True)
    store(spark.range(5), "numbers")
    with pytest.raises(KeyError):
        with module.stored_tables(spark):
            raise KeyError
    assert [p.name for p in (tmp_path / "trajloom").iterdir()] == ["other-app"]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "yarn"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_from_file_to_training_set_and_metrics(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    rows = [{**ROW, "prompt": f"Add {i} and 2.", "origin_label": ["negative", "positive"][i % 2]} for i in range(20)]
    write_lines(root / "train.jsonl", rows)
    write_lines(root / "test.jsonl", rows[:3])
    out, scores = str(tmp_path / "set"), str(tmp_path / "metrics")
    options = TokenOptions(template="alpaca", bos_token_id=2)
    tables = prepare_training_set(
        spark, str(root), out, options, LossOptions(), BatchOptions(per_device=4, epochs=2)
    )
    back = spark.read.parquet(out)
    assert back.count() == 40
    assert {"input_ids", "attention_mask", "labels", "old_logps", "advantage", "origin_is_negative"} <= set(back.columns)
    assert "nll_seq" not in back.columns and "prompt" not in back.columns
    policy = fit_policy(tables["train"], 200, bigram=True)
    evaluate({**tables, "math": tables["test"]}, policy, scores, options)
    found = {r.split: r for r in spark.read.json(scores).collect()}
    assert (found["train"].samples, found["eval"].samples, found["eval_math"].samples) == (20, 3, 3)
    assert found["train"].frac_origin_negative == 0.5


def code_points():
    return lambda text: [ord(c) for c in text]


def test_training_set_with_a_users_tokenizer(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{**ROW, "traj_id": 1, "response": f"ab{i % 2}"} for i in range(8)])
    out = str(tmp_path / "set")
    schema = read_json(spark, [path]).schema
    options = TokenOptions(max_prompt_length=2)
    tables = prepare_training_set(spark, path, out, options, batch_options=BatchOptions(epochs=1), schema=schema, make_encoder=code_points)
    assert tables["train"].count() == 8
    back = spark.read.parquet(out).collect()
    assert sorted(r.labels[2:] for r in back) == [[97, 98, 48]] * 4 + [[97, 98, 49]] * 4
    assert {r.traj_id for r in back} == {1} and len({r.row_id for r in back}) == 8


def test_metrics_of_a_split_and_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = lambda x: spark.createDataFrame([(x,)], "loss double")
    for run, split, loss in (("a", "train", 1.0), ("a", "eval", 2.0), ("b", "train", 3.0), ("a", "train", 4.0)):
        save_metrics(row(loss), path, split, run)
    found = {(r.run, r.split, r.loss) for r in spark.read.json(path).collect()}
    assert found == {("a", "train", 4.0), ("a", "eval", 2.0), ("b", "train", 3.0)}
    for bad in ("../x", "a/b", "", ".x"):
        with pytest.raises(ValueError):
            save_metrics(row(1.0), path, bad)
