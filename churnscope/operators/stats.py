"""Dataset-level statistics: exact quantiles, medians, feature stats.

Exact quantiles of any columns and probabilities take three passes over the
data, whatever its size:

1. the number of values of each column;
2. ``percentile_approx`` at every probability, moved down and up by more than
   its rank error: these data values surely enclose the two values between
   which the quantile is interpolated;
3. one grouped count of all brackets: values inside a bracket by value (ties,
   even one value holding a third of all rows, are one row), values below it
   in one row.

Running counts over the bracketed values (``ranking.running_sums``, spread
over ranges) then pick the order statistics.  Only scalars reach the driver.
Interpolation is ``a + (b - a) * t`` on positions ``(n - 1) * p`` (the
``quantile_cont`` / NumPy linear rule).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.operators.ranking import running_sums
from churnscope.session import release, stash

DEFAULT_ACCURACY = 10000


def exact_quantiles_multi(df: DataFrame, spec: dict[str, list[float]],
                          accuracy: int = DEFAULT_ACCURACY,
                          buckets: int | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several numeric columns (nulls and NaN skipped)."""
    names = list(spec)
    values = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}")
                         for i, c in enumerate(names)])
    counts = values.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
    # (column, bracket) -> wanted 0-based ranks
    wanted: dict[tuple[int, int], list[int]] = {}
    probs: dict[int, list[float]] = {}
    for i, c in enumerate(names):
        n = counts[i]
        for j, p in enumerate(spec[c] if n else ()):
            r = math.floor((n - 1) * p)
            wanted[i, j] = sorted({r, min(r + 1, n - 1)})
            margin = 2.0 / accuracy + 2.0 / n
            probs.setdefault(i, []).extend([max(0.0, p - margin), min(1.0, p + margin)])
    if not wanted:
        return {c: [None for _ in spec[c]] for c in names}
    edges = values.agg(*[F.percentile_approx(f"c{i}", ps, accuracy).alias(f"c{i}")
                         for i, ps in probs.items()]).first()
    brackets = {(i, j): (edges[f"c{i}"][2 * j], edges[f"c{i}"][2 * j + 1]) for i, j in wanted}
    # a value inside the bracket counts for itself, one below it as a null
    hits = [F.when(F.col(f"c{i}") <= hi, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                                 F.when(F.col(f"c{i}") >= lo, F.col(f"c{i}")).alias("x")))
            for (i, j), (lo, hi) in brackets.items()]
    grouped = stash(values.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*")
                    .groupBy("i", "j", "x").agg(F.count(F.lit(1)).alias("c")), "quantile-counts")
    below = {(r["i"], r["j"]): r["c"] for r in grouped.where("x IS NULL").collect()}
    cum = running_sums(grouped.where("x IS NOT NULL"), ["i", "j"], "x", ["c"], buckets=buckets)
    picked = None
    for (i, j), ranks in wanted.items():
        base = below.get((i, j), 0)
        for r in ranks:
            one = ((F.col("i") == i) & (F.col("j") == j) & (F.col("cum_c") > r - base)
                   & (F.col("cum_c") - F.col("c") <= r - base))
            picked = one if picked is None else picked | one
    found: dict[tuple[int, int, int], float] = {}
    for row in cum.where(picked).collect():  # two rows for each quantile at most
        key = row["i"], row["j"]
        upto = row["cum_c"] + below.get(key, 0)
        for r in wanted[key]:
            if upto - row["c"] <= r < upto:
                found[(*key, r)] = row["x"]
    release(grouped)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        out[c] = []
        for j, p in enumerate(spec[c]):
            if (i, j) not in wanted:
                out[c].append(None)
                continue
            position = (counts[i] - 1) * p
            ranks = wanted[i, j]
            a, b, t = found[i, j, ranks[0]], found[i, j, ranks[-1]], position - ranks[0]
            out[c].append(a if t == 0 or a == b else a + (b - a) * t)
    return out


def exact_quantiles(df: DataFrame, column, probs, accuracy: int = DEFAULT_ACCURACY,
                    buckets: int | None = None) -> list[float | None]:
    """Exact quantiles of one column."""
    values = df.select(F.col(column).alias("x")) if isinstance(column, str) else df.select(column.alias("x"))
    return exact_quantiles_multi(values, {"x": list(probs)}, accuracy, buckets)["x"]


def exact_median(df: DataFrame, column) -> float | None:
    return exact_quantiles(df, column, [0.5])[0]


@dataclass(frozen=True)
class FeatureStats:
    """Dataset medians that the two median flags compare against."""

    ratio_median: float | None
    monthly_median: float | None

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.ratio_median, self.monthly_median)],
            "ratio_median double, monthly_median double")

    @staticmethod
    def from_frame(df: DataFrame) -> "FeatureStats":
        row = df.first()
        return FeatureStats(row["ratio_median"], row["monthly_median"])


def charge_ratio():
    """MonthlyCharges / CLV, a zero CLV read as 1."""
    return F.col("MonthlyCharges") / F.when(F.col("CLV") == 0, F.lit(1)).otherwise(F.col("CLV"))


def fit_feature_stats(df: DataFrame) -> FeatureStats:
    """Medians of MonthlyCharges / CLV and of MonthlyCharges."""
    base = df.select(charge_ratio().alias("ratio"), F.col("MonthlyCharges").alias("monthly"))
    med = exact_quantiles_multi(base, {"ratio": [0.5], "monthly": [0.5]})
    return FeatureStats(med["ratio"][0], med["monthly"][0])


@dataclass(frozen=True)
class TrainStats:
    """What later steps need to know about the training split: medians and CLV edges."""

    medians: FeatureStats
    clv_edges: tuple[float | None, ...]


def fit_train_stats(train: DataFrame) -> TrainStats:
    """All of them in one set of passes."""
    q = exact_quantiles_multi(train.select(charge_ratio().alias("ratio"), "MonthlyCharges", "CLV"),
                              {"ratio": [0.5], "MonthlyCharges": [0.5], "CLV": [0.25, 0.5, 0.75]})
    return TrainStats(FeatureStats(q["ratio"][0], q["MonthlyCharges"][0]), tuple(q["CLV"]))
