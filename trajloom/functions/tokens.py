"""Token-array expressions. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajloom.options import TokenOptions

# Runs of letters and digits, or one other character that is not space.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def split_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), times)


def with_bos(ids: Column, options: TokenOptions) -> Column:
    if options.bos_token_id is None:
        return ids
    return F.concat(F.array(F.lit(options.bos_token_id)), ids)


def cut_prompt(ids: Column, options: TokenOptions) -> Column:
    limit = options.max_prompt_length
    if options.truncation_mode == "keep_start":
        return F.slice(ids, 1, limit)
    # The last 0 items are, as in a Python slice from -0, the whole prompt.
    if limit == 0:
        return ids
    # slice() from the end is empty when the array is shorter than that.
    return F.when(F.size(ids) > limit, F.slice(ids, -limit, limit)).otherwise(ids)


def model_prompt(prompt_ids: Column, options: TokenOptions) -> Column:
    return cut_prompt(with_bos(prompt_ids, options), options)


def model_inputs(prompt_ids: Column, response_ids: Column, options: TokenOptions) -> dict[str, Column]:
    """``input_ids``, ``attention_mask`` and ``labels`` of one prompt and response."""
    prompt = model_prompt(prompt_ids, options)
    limit = options.max_length
    input_ids = F.slice(F.concat(prompt, response_ids), 1, limit)
    masked = repeat(options.label_pad_token_id, F.size(prompt))
    return {
        "input_ids": input_ids,
        "attention_mask": repeat(1, F.size(input_ids)),
        "labels": F.slice(F.concat(masked, response_ids), 1, limit),
    }


def pad_right(values: Column, pad: int, count: Column) -> Column:
    return F.concat(values, repeat(pad, count))


def completion_span(labels: Column, label_pad: int) -> tuple[Column, Column]:
    """First position of the completion and the one after its last; NULLs without one."""
    kept = F.transform(labels, lambda label, pos: F.when(label != label_pad, pos))
    return F.array_min(kept), F.array_max(kept) + 1


def scored_tokens(input_ids: Column, labels: Column, label_pad: int) -> Column:
    """Array of (pos, prev, token): the completion tokens a model gives a log-prob.

    Position 0 has no predecessor to predict it from, so it is left out.
    """
    before = F.concat(
        F.array(F.lit(None).cast("int")),
        F.slice(input_ids, F.lit(1), F.greatest(F.size(input_ids) - 1, F.lit(0))),
    )
    # Zipped first: the exploded rows then carry scalars, not a copy of each array.
    pairs = F.zip_with(
        before, labels, lambda prev, label: F.struct(prev.alias("prev"), label.alias("token"))
    )
    numbered = F.transform(
        pairs,
        lambda pair, pos: F.struct(
            pos.alias("pos"), pair["prev"].alias("prev"), pair["token"].alias("token")
        ),
    )
    return F.filter(numbered, lambda item: (item["pos"] >= 1) & (item["token"] != label_pad))


def log_softmax_at(logits: Column, target: Column) -> Column:
    """Log-softmax of an array of logits at a 0-based target index.

    -inf is a masked token, which as a target has log-prob -inf; with nothing but masked
    tokens, +inf or NaN the result is NaN. A target beyond the array, or at a null logit, is an
    error; a null array or target gives null.
    """
    top = F.array_max(logits).cast("double")
    total = F.aggregate(
        logits, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.exp(x.cast("double") - top), F.lit(0.0))
    )
    picked = F.get(logits, target).cast("double")
    missing = logits.isNotNull() & target.isNotNull() & picked.isNull()
    error = F.raise_error(F.lit("a target has no logit")).cast("double")
    return F.when(missing, error).otherwise(picked - top - F.ln(total))
