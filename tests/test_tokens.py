"""Token lists against worked examples and a plain-Python construction."""

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trajloom.functions.templates import render
from trajloom.functions.tokens import completion_span, log_softmax_at, scored_tokens
from trajloom.operators.batching import pad_batches
from trajloom.operators.enrich import apply_template
from trajloom.operators.tokenise import build_vocabulary, encode, truncation_audit, with_model_inputs
from trajloom.options import TokenOptions

IDS = "traj_id int, prompt_ids array<int>, response_ids array<int>"
PROMPT, RESPONSE = [11, 12, 13, 14], [21, 22, 23]
M = -100


def inputs(spark, prompt, response, **options):
    df = spark.createDataFrame([(1, prompt, response)], IDS)
    return with_model_inputs(df, TokenOptions(bos_token_id=1, **options)).first()


def positions(spark, row):
    df = spark.createDataFrame([(row.input_ids, row.labels)], "input_ids array<int>, labels array<int>")
    out = df.select(F.inline(scored_tokens(F.col("input_ids"), F.col("labels"), M))).collect()
    return [(r.pos, r.prev, r.token) for r in out]


@pytest.mark.parametrize(
    "options, prompt, response, ids, labels, scored",
    [
        ({"max_prompt_length": 3, "max_length": 5}, PROMPT, RESPONSE,
         [12, 13, 14, 21, 22], [M, M, M, 21, 22], [3, 4]),
        ({"max_prompt_length": 3, "max_length": 5, "truncation_mode": "keep_start"}, PROMPT, RESPONSE,
         [1, 11, 12, 21, 22], [M, M, M, 21, 22], [3, 4]),
        ({}, PROMPT, RESPONSE, [1, 11, 12, 13, 14, 21, 22, 23], [M] * 5 + [21, 22, 23], [5, 6, 7]),
        ({}, PROMPT, [], [1, 11, 12, 13, 14], [M] * 5, []),
        ({"max_prompt_length": 0, "max_length": 5, "truncation_mode": "keep_start"}, PROMPT, RESPONSE,
         [21, 22, 23], [21, 22, 23], [1, 2]),
        ({"max_prompt_length": 0, "max_length": 5}, PROMPT, RESPONSE,
         [1, 11, 12, 13, 14], [M] * 5, []),
        ({"max_length": 0}, PROMPT, RESPONSE, [], [], []),
    ],
)
def test_golden_lists(spark, options, prompt, response, ids, labels, scored):
    row = inputs(spark, prompt, response, **options)
    assert (row.input_ids, row.labels) == (ids, labels)
    assert row.attention_mask == [1] * len(ids)
    found = positions(spark, row)
    assert [p for p, _, _ in found] == scored
    assert all(prev == ids[p - 1] and token == ids[p] for p, prev, token in found)


def plain_inputs(prompt, response, o: TokenOptions):
    ids = ([] if o.bos_token_id is None else [o.bos_token_id]) + prompt
    n = o.max_prompt_length
    if len(ids) > n:
        ids = ids[:n] if o.truncation_mode == "keep_start" else ids[-n:]
    return (ids + response)[: o.max_length], ([M] * len(ids) + response)[: o.max_length]


lists = st.lists(st.integers(5, 99), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(lists, lists), min_size=1, max_size=20),
    st.builds(
        TokenOptions, max_length=st.integers(0, 20), max_prompt_length=st.integers(0, 14),
        truncation_mode=st.sampled_from(["keep_start", "keep_end"]),
        bos_token_id=st.sampled_from([None, 1]),
    ),
)
def test_matches_plain_python(spark, pairs, options):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], IDS)
    start, end = completion_span(F.col("labels"), M)
    rows = with_model_inputs(df, options).withColumns({"start": start, "end": end})
    audit = truncation_audit(rows, options)
    for row in audit.collect():
        ids, labels = plain_inputs(*pairs[row.traj_id], options)
        assert (row.input_ids, row.labels) == (ids, labels)
        assert len(row.input_ids) == len(row.labels) == len(row.attention_mask)
        kept = [i for i, label in enumerate(labels) if label != M]
        assert (row.start, row.end) == ((kept[0], kept[-1] + 1) if kept else (None, None))
        assert row.response_kept == len(kept)
        assert row.response_cut == (len(kept) < len(pairs[row.traj_id][1]))


def test_bad_options():
    with pytest.raises(ValueError, match="truncation mode"):
        TokenOptions(truncation_mode="middle")
    with pytest.raises(ValueError):
        TokenOptions(max_length=-1)


def test_pad_id_falls_back_to_eos_then_zero():
    assert TokenOptions().pad_id == 0
    assert TokenOptions(eos_token_id=7).pad_id == 7
    assert TokenOptions(eos_token_id=7, pad_token_id=5).pad_id == 5


def test_padding(spark):
    schema = "b int, i int, input_ids array<int>, attention_mask array<int>, labels array<int>"
    rows = [
        (0, 0, [12, 13, 14, 21, 22], [1] * 5, [M, M, M, 21, 22]),
        (0, 1, [1, 11, 21], [1] * 3, [M, M, 21]),
        (1, 2, [5], [1], [5]),
        (1, 3, [], [], []),
    ]
    df = spark.createDataFrame(rows, schema)
    out = {r.i: r for r in pad_batches(df, TokenOptions(pad_token_id=9), ["b"]).collect()}
    assert (out[0].input_ids, out[0].batch_max_len) == ([12, 13, 14, 21, 22], 5)
    assert out[1].input_ids == [1, 11, 21, 9, 9]
    assert out[1].attention_mask == [1, 1, 1, 0, 0]
    assert out[1].labels == [M, M, 21, M, M]
    assert (out[3].input_ids, out[3].labels) == ([9], [M])


# --- Templates ----------------------------------------------------------------


@pytest.mark.parametrize(
    "name, start, end",
    [
        ("alpaca", "Below is an instruction", "### Response:"),
        ("deepseek-math", "User: ", "within \\boxed{}.\n\nAssistant:"),
        ("qwen2-boxed", "<|im_start|>system\nYou are a helpful assistant.", "<|im_start|>assistant\n"),
        ("ours", "<|im_start|>system\nYou are Qwen", "<|im_end|>\n<|im_start|>assistant\n"),
    ],
)
def test_templates_keep_the_instruction_as_it_is(spark, name, start, end):
    text = "a {b} {} {{c}} %s \\1 $1 <|im_end|>"
    df = spark.createDataFrame([(text, "r", 1.0)], "prompt string, response string, nll_seq double")
    row = apply_template(df, TokenOptions(template=name)).first()
    assert row.prompt.startswith(start) and row.prompt.endswith(end) and text in row.prompt
    assert (row.response, row.nll_seq) == ("r", 1.0)


def test_template_errors_and_nulls(spark):
    with pytest.raises(ValueError, match="Unknown prompt template"):
        render("chatml", F.lit("x"))
    df = spark.createDataFrame([(None, "r")], "prompt string, response string")
    assert "user\nNone<|im_end|>" in apply_template(df).first().prompt
    bad = spark.createDataFrame([("p", None)], "prompt string, response string")
    with pytest.raises(PySparkException, match="response"):
        apply_template(bad).count()


# --- Vocabulary and encoding --------------------------------------------------

TEXTS = [
    ("a b a", "b, c!"), ("", "a"), ("été 12x", ""), (None, "a a a a"), ("日本 語", "x_y\u00a0z"), ("", ""),
]


def plain_tokens(text):
    return regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]", text or "")


def text_table(spark):
    return spark.createDataFrame(
        [(i, *pair) for i, pair in enumerate(TEXTS)], "traj_id int, prompt string, response string"
    )


@pytest.mark.parametrize("salted", [False, True])
def test_vocabulary_and_encoding(spark, salted):
    df = text_table(spark)
    words = build_vocabulary(df, ["prompt", "response"])
    counts = {}
    for pair in TEXTS:
        for text in pair:
            for token in plain_tokens(text):
                counts[token] = counts.get(token, 0) + 1
    ranked = sorted(counts, key=lambda t: (-counts[t], t.encode()))
    ids = {token: i + 4 for i, token in enumerate(ranked)}
    assert {r.token: (r.n, r.token_id) for r in words.collect()} == {t: (counts[t], ids[t]) for t in ids}

    known = words.where("token <> 'b'")
    limits = {"broadcast_bytes": 0, "hot_rows": 2} if salted else {}
    coded = encode(df, ["prompt", "response"], known, **limits)
    assert coded.columns == [*df.columns, "prompt_ids", "response_ids"]
    found = {r.traj_id: (r.prompt_ids, r.response_ids) for r in coded.collect()}
    code = lambda text: [1 if t == "b" else ids[t] for t in plain_tokens(text)]
    assert found == {i: (code(p), code(r)) for i, (p, r) in enumerate(TEXTS)}


@pytest.mark.parametrize("salted", [False, True])
def test_rows_with_equal_or_no_ids_keep_their_tokens(spark, salted):
    rows = [("x", "a b"), ("x", "d"), (None, "g"), (None, "g"), ("x", "a b")]
    df = spark.createDataFrame(rows, "traj_id string, response string")
    words = build_vocabulary(df, ["response"])
    ids = {r.token: r.token_id for r in words.collect()}
    limits = {"broadcast_bytes": 0, "hot_rows": 1} if salted else {}
    found = [(r.traj_id, r.response, r.response_ids) for r in encode(df, ["response"], words, **limits).collect()]
    expected = [(i, t, [ids[w] for w in t.split()]) for i, t in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


# Written out here: the engine's texts are not the ones to compare with.
BOXED = "Please reason step by step, and put your final answer within \\boxed{}."
START, END = "<|im_start|>", "<|im_end|>"
WHOLE = {
    "deepseek-math": "User: Do it.\n" + BOXED + "\n\nAssistant:",
    "qwen2-boxed": f"{START}system\nYou are a helpful assistant.{END}\n{START}user\nDo it.\n{BOXED}{END}\n{START}assistant\n",
    "ours": f"{START}system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.{END}\n{START}user\nDo it.{END}\n{START}assistant\n",
    "alpaca": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\nDo it.\n\n### Response:",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_template_texts(spark, name):
    df = spark.createDataFrame([("Do it.", "r")], "prompt string, response string")
    assert apply_template(df, TokenOptions(template=name)).first().prompt == WHOLE[name]


def test_log_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 1002.0], 1), ([-5.0], 0)], "x array<double>, t int")
    out = [r[0] for r in df.select(log_softmax_at(F.col("x"), F.col("t"))).collect()]
    assert out == pytest.approx([-1.4076059644443806, 0.0])
