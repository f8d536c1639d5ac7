"""Off-policy maths per trajectory.

Spark sorts NaN above every number and lets ``least``/``greatest`` prefer the
other operand, so each clamp carries a NaN guard: NaN in, NaN out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.functions.casts import as_float, strip
from trajloom.options import LossOptions


def origin_flag(label: Column, dtype: T.DataType) -> Column:
    """1.0 for trajectories of negative origin, else 0.0.

    Text is negative only if it reads "negative" apart from case and outer space.
    A number is taken as the flag itself, so 1 and true mean negative.
    """
    if isinstance(dtype, T.StringType):
        tidy = F.lower(strip(label)) == "negative"
        # The two usual spellings first: most rows then skip the cleaning.
        return (
            F.when(label == "negative", 1.0)
            .when(label == "positive", 0.0)
            .when(tidy, 1.0)
            .otherwise(0.0)
        )
    return F.coalesce(as_float(label, dtype), F.lit(0.0))


def flag_is_set(flag: Column) -> Column:
    return (flag > 0.5) & ~F.isnan(flag)


def advantage_or_default(advantage: Column, dtype: T.DataType, default: float) -> Column:
    return F.coalesce(as_float(advantage, dtype), F.lit(float(default)))


def clipped_ratio(log_ratio: Column, clip_ratio_max: float) -> Column:
    """exp(log_ratio) with an upper clip; exactly ``clip_ratio_max`` once clipped."""
    clipped = (log_ratio >= math.log(clip_ratio_max)) & ~F.isnan(log_ratio)
    return F.when(clipped, F.lit(float(clip_ratio_max))).otherwise(F.exp(log_ratio))


def capped_weight(ratio: Column, alpha: float) -> Column:
    clamped = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(float(alpha)))
    return F.when(F.isnan(ratio), ratio).otherwise(clamped)


def loss_stages(
    options: LossOptions = LossOptions(), with_advantage: bool = True, with_flag: bool = True
) -> list[dict[str, Column]]:
    """Loss, reward and diagnostics of one trajectory, as projections to apply in turn.

    Inputs are the columns ``policy_logps``, ``old_logps``, ``completion_len`` and, if
    present, ``advantage`` and ``origin_is_negative``. Without an advantage the default
    applies; without an origin flag every weight is 1. A stage only reads earlier ones,
    so that the generated code computes each value once.
    """
    pol, old, size = F.col("policy_logps"), F.col("old_logps"), F.col("completion_len")
    ratio, weight = F.col("ratio"), F.lit(1.0)
    if with_flag:
        weight = F.when(flag_is_set(F.col("origin_is_negative")), F.col("w")).otherwise(weight)
    if with_advantage and options.use_dataset_advantage:
        gain = F.col("advantage")
    else:
        gain = F.lit(float(options.default_advantage))
    by = size if options.length_normalize else None
    used_pol, used_old = (pol, old) if by is None else (pol / by, old / by)
    return [
        {"log_ratio": used_pol - used_old},
        {"ratio": clipped_ratio(F.col("log_ratio"), options.clip_ratio_max)},
        {"w": capped_weight(ratio, options.alpha)},
        {
            "weight": weight,
            "advantage_used": gain,
            "reward": (pol - old) / size,
            "capped": (ratio >= float(options.alpha)) & ~F.isnan(ratio),
        },
        {"coef": -F.col("advantage_used") * F.col("weight")},
        {"loss": F.col("coef") * used_pol},
    ]
