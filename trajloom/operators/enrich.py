"""From recorded columns to the numeric columns of the loss, and the loss itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajloom.functions.casts import as_float
from trajloom.functions.offpolicy import advantage_or_default, loss_stages, origin_flag
from trajloom.functions.templates import render
from trajloom.options import LossOptions, TokenOptions

NLL = "nll_seq"
ADVANTAGE = "advantage"
ORIGIN = "origin_label"


def require_nll_column(df: DataFrame, options: LossOptions = LossOptions()) -> None:
    """The trainer's own check: raises before any job when the NLL column is missing."""
    if options.require_old_nll and NLL not in df.columns:
        raise ValueError(f"the loss needs a column `{NLL}`; there are {df.columns}")


def with_old_logps(df: DataFrame, options: LossOptions = LossOptions()) -> DataFrame:
    """Add ``old_logps`` = -nll. A null NLL is an error, or 0.0 in lenient mode."""
    require_nll_column(df, options)
    if NLL not in df.columns:
        known = F.col("old_logps").cast("double") if "old_logps" in df.columns else F.lit(None)
        return df.withColumn("old_logps", F.coalesce(known, F.lit(0.0)))
    nll = F.col(NLL)
    value = as_float(nll, df.schema[NLL].dataType)
    # In a filter: as projected columns the checks would be pruned when unused.
    wrong = F.concat(F.lit(f"`{NLL}` is not a number: "), nll.cast("string"))
    valid = F.when(nll.isNotNull() & value.isNull(), F.raise_error(wrong).cast("boolean"))
    if options.require_old_nll:
        valid = valid.when(nll.isNull(), F.raise_error(F.lit(f"a null in `{NLL}`")).cast("boolean"))
    df = df.where(valid.otherwise(F.lit(True)))
    return df.withColumn("old_logps", F.coalesce(-value, F.lit(0.0)))


def with_advantage(df: DataFrame, options: LossOptions = LossOptions()) -> DataFrame:
    if ADVANTAGE not in df.columns:
        return df.withColumn(ADVANTAGE, F.lit(float(options.default_advantage)))
    dtype = df.schema[ADVANTAGE].dataType
    value = advantage_or_default(F.col(ADVANTAGE), dtype, options.default_advantage)
    return df.withColumn(ADVANTAGE, value)


def with_origin_flag(df: DataFrame) -> DataFrame:
    """Add ``origin_is_negative``; without a label column every row is positive."""
    if ORIGIN not in df.columns:
        return df.withColumn("origin_is_negative", F.lit(0.0))
    flag = origin_flag(F.col(ORIGIN), df.schema[ORIGIN].dataType)
    return df.withColumn("origin_is_negative", flag)


def enrich(df: DataFrame, options: LossOptions = LossOptions()) -> DataFrame:
    """``old_logps``, ``advantage`` and ``origin_is_negative``, ready for the loss."""
    return with_origin_flag(with_advantage(with_old_logps(df, options), options))


def model_batch(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only what a model batch holds: the token lists, the three vectors, ``keep``."""
    wanted = [
        "input_ids", "attention_mask", "labels", "old_logps", ADVANTAGE, "origin_is_negative",
    ]
    return df.select(*keep, *[name for name in wanted if name in df.columns])


def with_loss(df: DataFrame, options: LossOptions = LossOptions()) -> DataFrame:
    """Add the loss columns to rows that have scores and the enriched columns."""
    known = set(df.columns)
    for stage in loss_stages(options, ADVANTAGE in known, "origin_is_negative" in known):
        df = df.withColumns(stage)
    return df


def apply_template(df: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """Replace ``prompt`` by its rendered text. A null response is an error."""
    rendered = render(options.template, F.col("prompt"))
    error = F.raise_error(F.lit("a null in `response`")).cast("boolean")
    checked = df.where(F.when(F.col("response").isNull(), error).otherwise(F.lit(True)))
    return checked.withColumn("prompt", rendered)


def preview(df: DataFrame, key: str, rows: int = 3) -> DataFrame:
    """A few rows in seeded order, for a look at label, NLL and length."""
    nll = as_float(F.col(NLL), df.schema[NLL].dataType)
    columns = [c for c in (ORIGIN, NLL) if c in df.columns]
    if "input_ids" in df.columns:
        columns.append(F.size("input_ids").alias("input_length"))
    return (
        df.orderBy(key).limit(rows).select(key, *columns, (-nll).alias("log_mu"))
    )
