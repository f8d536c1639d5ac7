"""Prompt templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "{instruction}"

# The template texts; the instruction goes where the slot stands.
TEMPLATES = {
    "alpaca": (
        "Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.\n\n"
        "### Instruction:\n{instruction}\n\n### Response:"
    ),
    "deepseek-math": (
        "User: {instruction}\n"
        "Please reason step by step, and put your final answer within \\boxed{}.\n\n"
        "Assistant:"
    ),
    "qwen2-boxed": (
        "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
        "<|im_start|>user\n{instruction}\n"
        "Please reason step by step, and put your final answer within \\boxed{}.<|im_end|>\n"
        "<|im_start|>assistant\n"
    ),
    "ours": (
        "<|im_start|>system\n"
        "You are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n"
        "<|im_start|>user\n{instruction}<|im_end|>\n"
        "<|im_start|>assistant\n"
    ),
}


def render(template: str, instruction: Column) -> Column:
    """The instruction inside its template. Braces in the instruction stay as they are."""
    if template not in TEMPLATES:
        raise ValueError(f"Unknown prompt template: {template}")
    before, after = TEMPLATES[template].split(SLOT)
    text = F.coalesce(instruction.cast("string"), F.lit("None"))
    return F.concat(F.lit(before), text, F.lit(after))
