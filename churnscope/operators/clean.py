"""Cleaning: total-charge coercion and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.text import to_double
from churnscope.operators.stats import exact_median


def coerce_total_charges(df: DataFrame) -> DataFrame:
    """Text -> double; blank with tenure 0 -> 0; tenure > 0 -> monthly x tenure."""
    tc = to_double("TotalCharges")
    t, m = F.col("tenure"), F.col("MonthlyCharges")
    filled = (F.when(tc.isNotNull(), tc)
              .when(t == 0, F.lit(0.0))
              .when(t > 0, m * t))
    return df.withColumn("TotalCharges", filled.cast("double"))


def clean_total_charges(df: DataFrame, median: float | None = None) -> DataFrame:
    """B5 = B1 -> B4.

    B4 (median of the remaining values for leftovers) costs extra passes, so a
    cheap existence probe decides whether it runs at all; a caller may also
    pass a median fitted elsewhere (e.g. on the training split).
    """
    out = coerce_total_charges(df)
    if median is None:
        has_left = out.where(F.col("TotalCharges").isNull()).limit(1).count() > 0
        if not has_left:
            return out
        median = exact_median(out, "TotalCharges")
    if median is None:
        return out
    return out.withColumn("TotalCharges",
                          F.coalesce(F.col("TotalCharges"), F.lit(float(median))))
