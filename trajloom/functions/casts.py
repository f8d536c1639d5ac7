"""Text and number conversions that follow Python's ``str.strip`` and ``float``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters that str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: what float() accepts once underscores between digits are gone.
FLOAT_TEXT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
NAN_TEXT = r"^[+-]?(?i:nan)$"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def float_text(text: Column) -> Column:
    """Text to double by Python's rules; NULL where ``float()`` would raise."""
    clean = F.regexp_replace(strip(text), r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(clean.rlike(NAN_TEXT), F.lit(float("nan"))).when(
        clean.rlike(FLOAT_TEXT), clean.try_cast("double")
    )


def as_float(column: Column, dtype: T.DataType) -> Column:
    """Any column to double; NULL where the value is null or not a number."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if isinstance(dtype, T.StringType):
        return float_text(column)
    return F.lit(None).cast("double")
