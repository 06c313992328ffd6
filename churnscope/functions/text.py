"""Null-aware text predicates with the semantics of the pandas code paths.

All are built-in Column expressions (whole-stage codegen, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every ASCII whitespace, SQL trim only spaces.
WHITESPACE = " \t\n\r\x0b\x0c"

NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def norm(c) -> Column:
    """lower(strip(x)); null stays null."""
    return F.lower(strip(c))


def is_yes(c) -> Column:
    """``str(x).strip().lower() == 'yes'``; a null reads as 'nan' -> False."""
    return F.coalesce(norm(c) == "yes", F.lit(False))


def eq_norm(c, value: str) -> Column:
    return F.coalesce(norm(c) == value, F.lit(False))


def eq_lower(c, value: str) -> Column:
    """``x.str.lower() == value`` (no strip); null -> False."""
    return F.coalesce(F.lower(col(c)) == value, F.lit(False))


def ne_lower(c, value: str) -> Column:
    """``x.str.lower() != value`` (no strip); pandas gives True for null."""
    return ~F.lower(col(c)).eqNullSafe(value)


def flag(cond: Column) -> Column:
    """Boolean -> int 0/1, null -> 0."""
    return F.when(cond, 1).otherwise(0)


def to_double(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: numeric text -> double, else null."""
    c = col(c)
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def nonzero(c, replacement=1) -> Column:
    """``x.replace(0, 1)``: exact zero only; null stays null."""
    c = col(c)
    return F.when(c == 0, F.lit(replacement)).otherwise(c)


def at_least(c, bound) -> Column:
    """``max(x, bound)`` in the app code (Python max, no null)."""
    return F.greatest(col(c), F.lit(bound))


def clip_lower(c, bound) -> Column:
    """``Series.clip(lower=b)`` keeps NaN (``greatest`` would not)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(bound)))


def clip_upper(c, bound) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(bound)))
