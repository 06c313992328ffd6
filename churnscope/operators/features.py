"""Feature projections as DataFrame -> DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import features as fx
from churnscope.operators.stats import FeatureStats, fit_feature_stats
from churnscope.sources.subscribers import RAW_COLUMNS, require_columns


def _apply(df: DataFrame, pairs) -> DataFrame:
    names = [n for n, _ in pairs]
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[c.alias(n) for n, c in pairs])


def add_clv(df: DataFrame) -> DataFrame:
    """C1 + C2: ExpectedTenure and CLV."""
    require_columns(df, ["Contract", "MonthlyCharges"], "add_clv")
    df = _apply(df, [("ExpectedTenure", fx.expected_tenure())])
    return _apply(df, [("CLV", fx.clv())])


def engineer_features(df: DataFrame, stats: FeatureStats | None = None,
                      keep_helpers: bool = False) -> DataFrame:
    """C3-C29.  ``stats`` defaults to medians over ``df`` itself (as in the
    reference's preparation step); pass train-fitted stats to avoid leakage."""
    require_columns(df, ["CLV", "ExpectedTenure"], "engineer_features")
    staged = _apply(df, fx.training_stage1())
    if stats is None:
        stats = fit_feature_stats(staged)
    out = _apply(staged, fx.training_stage2(_lit(stats.ratio_median),
                                            _lit(stats.monthly_median)))
    return out if keep_helpers else out.drop("clv_ratio")


def _lit(v):
    return F.lit(v).cast("double")


def select_model_columns(df: DataFrame, id_col: str | None = "customerID") -> DataFrame:
    """Id (if present) + 30 numeric + 17 categorical + target; missing pruned."""
    cols = [c for c in fx.NUMERIC_FEATURES + fx.CATEGORICAL_FEATURES if c in df.columns]
    head = [id_col] if id_col and id_col in df.columns else []
    return df.select(*head, *cols, fx.TARGET)


def serving_features(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """The scoring form's feature definition applied to raw subscriber rows.

    The categorical columns are what the form sends: its toggles know Yes and
    No only, so values like 'No internet service' become No.
    """
    raw = df.drop("TotalCharges")
    staged = _apply(raw, fx.serving_inputs())
    staged = _apply(staged, fx.serving_stage1())
    staged = _apply(staged, fx.serving_stage2(_lit(stats.ratio_median),
                                              _lit(stats.monthly_median)))
    staged = _apply(staged, fx.serving_stage3(_lit(stats.ratio_median)))
    staged = _apply(staged, [("remaining_value_ratio",
                              F.col("remaining_value") / F.greatest(F.col("CLV"), F.lit(1.0)))])
    staged = _apply(staged, fx.serving_payload())
    return staged.drop(*[n for n, _ in fx.serving_inputs()])


def paired_features(table: DataFrame, stats: FeatureStats, columns) -> DataFrame:
    """Training values (``t_`` + name) and serving values of the same rows, side by side.

    ``table`` has the raw columns and the training features of each row."""
    raw = [c for c in RAW_COLUMNS if c != "TotalCharges"]
    both = table.select(*raw, *[F.col(c).alias(f"t_{c}") for c in columns])
    return serving_features(both, stats)
