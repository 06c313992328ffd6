"""The ``scored`` table of FIXTURES.md section 3: ``(model, split, customerID, y, prob)``.

Three point-based scorers over the prepared subscriber features stand in
for fitted models when a result must be checked exactly: every ``prob`` is
a multiple of 1/16 (clipped to [0, 1]), so threshold comparisons are exact
and ties are frequent.  Fitted MLlib models produce the same layout
(``churnscope.operators.ml.score``); the scorers borrow their names, so that
the reports' model order and titles are covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed point weights of the three fixture scorers.
SCORERS = {
    "logreg": {"short_contract": 3, "internet_no_tech_support": 2, "early_tenure_flag": 2,
               "is_fiber_optic": 2, "is_electronic_check": 1, "noise": (7, 5)},
    "rf": {"short_contract": 4, "early_tenure_flag": 3, "is_fiber_optic": 2,
           "is_electronic_check": 2, "is_auto_pay": -1, "noise": (13, 6)},
    "xgb": {"short_contract": 5, "early_tenure_flag": 2, "is_fiber_optic": 3,
            "is_electronic_check": 2, "noise": (3, 4)},
}


def id_number(c: Column) -> Column:
    """A number of 28 bits from a text id."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 7), 16, 10).cast("bigint")


def _points(weights: dict) -> Column:
    total = F.lit(0)
    for name, w in weights.items():
        if name == "noise":
            mult, mod = w
            total = total + (id_number(F.col("customerID")) * mult) % mod
        elif name == "short_contract":
            total = total + w * (1 - F.col("is_long_contract"))
        else:
            total = total + w * F.col(name)
    return total


def scorer_column(model: str) -> Column:
    """Probability column of one fixture scorer over feature columns."""
    return F.least(F.greatest(_points(SCORERS[model]), F.lit(0)), F.lit(16)) / F.lit(16.0)


def fixture_scores(prepared: DataFrame) -> DataFrame:
    """Long table of the three fixture scorers over every prepared row."""
    y = F.col("ChurnFlag").cast("int").alias("y")
    cols = [F.struct(F.lit(m).alias("model"),
                     (F.least(F.greatest(_points(w), F.lit(0)), F.lit(16)) / F.lit(16.0)).alias("prob"))
            for m, w in SCORERS.items()]
    return prepared.select("split", "customerID", y, F.explode(F.array(*cols)).alias("s")).select(
        F.col("s.model").alias("model"), "split", "customerID", "y", F.col("s.prob").alias("prob"))
