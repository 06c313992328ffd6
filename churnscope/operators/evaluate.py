"""Evaluation of scored tables.

Input: a long table ``(model, split, y, prob)`` (plus ids).  Every metric is
computed per ``(model, split)`` key in one plan; the keys are few, the rows
many.  Scores are first reduced to distinct values per key with a partial
aggregate, so ties, even one score holding a third of all rows, are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.operators.ranking import running_sums
from churnscope.session import stash

KEYS = ["model", "split"]
# Threshold grid 0.30..0.80 step 0.01, recall floor, fallback.
GRID_START, GRID_STEPS = 30, 51          # thresholds (30 + j) / 100, j = 0..50
RECALL_MIN = 0.60
DEFAULT_THRESHOLD = 0.60
MODEL_ORDER = ["logreg", "rf", "xgb"]
MODEL_LABELS = {"logreg": "LOGREG", "rf": "RANDOM FOREST", "xgb": "XGBOOST"}  # the report's titles


def _div(num: Column, den: Column) -> Column:
    """``num / den`` with 0 for a zero denominator (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def rates(df: DataFrame) -> DataFrame:
    """G2 from counts tp, fp, fn: precision, recall, f1 = 2tp / (2tp + fp + fn)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select("*", _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                     _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(scored: DataFrame, threshold, keys=KEYS) -> DataFrame:
    """G1: tn, fp, fn, tp with pred = prob >= threshold (a number or a column)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col("prob") >= thr
    count = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    return score_counts(scored, keys).groupBy(*keys).agg(
        count("neg", ~pred).alias("tn"), count("neg", pred).alias("fp"),
        count("pos", ~pred).alias("fn"), count("pos", pred).alias("tp"))


def score_counts(scored: DataFrame, keys=KEYS, materialize: bool = False) -> DataFrame:
    """One row per (keys, prob) with the number of positives and negatives.

    Every evaluation operator takes either scored rows or this table, so a
    caller with several of them writes it once (``materialize``) and no model
    scores its rows twice.
    """
    if {"pos", "neg"} <= set(scored.columns):
        return scored
    counts = scored.groupBy(*keys, "prob").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    return stash(counts, "score_counts") if materialize else counts


def roc_auc(scored: DataFrame, keys=KEYS, buckets: int | None = None) -> DataFrame:
    """AUC = sum over scores of pos * (neg_below + neg / 2) / (P * N).

    Null when a key has only one class.  Ties count one half, as the
    trapezoid rule does.
    """
    counts = score_counts(scored, keys, materialize=True)
    cum = running_sums(counts, keys, "prob", ["neg"], buckets=buckets)
    terms = cum.select(*keys, "pos", "neg",
                       (F.col("pos").cast("double")
                        * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg"))).alias("t"))
    agg = terms.groupBy(*keys).agg(F.sum("t").alias("num"), F.sum("pos").alias("P"),
                                   F.sum("neg").alias("N"))
    den = F.lit(2.0) * F.col("P") * F.col("N")
    return agg.select(*keys, F.when(den > 0, F.col("num") / den).alias("auc"))


def bin_metrics(scored: DataFrame, threshold, keys=KEYS) -> DataFrame:
    """Precision, recall, f1, auc, tn, fp, fn, tp, used_threshold."""
    thr_col = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    more = [k for k in scored.columns if k not in (*keys, "prob", "y", "pos", "neg")] \
        if isinstance(threshold, Column) else []
    counts = score_counts(scored, [*keys, *more], materialize=True)
    out = rates(confusion(counts, thr_col, keys)).join(roc_auc(counts, keys), keys, "left")
    if not isinstance(threshold, Column):
        out = out.withColumn("used_threshold", F.lit(float(threshold)))
    return out


def _grid_index(prob: Column) -> Column:
    """Number of grid thresholds (30 + j) / 100 that are <= prob, in 0..51."""
    j0 = F.floor(prob * 100).cast("long") - GRID_START
    thr = lambda j: (F.lit(GRID_START) + j) / F.lit(100.0)
    j = (F.when(thr(j0) > prob, j0 - 1).when(thr(j0 + 1) <= prob, j0 + 1).otherwise(j0))
    return F.least(F.greatest(j + 1, F.lit(0)), F.lit(GRID_STEPS)).cast("int")


def threshold_sweep(scored: DataFrame, keys=KEYS) -> DataFrame:
    """Confusion and rates at the 51 grid thresholds in one pass.

    Each row gets its grid index; a grouped count per (key, index) has at
    most 52 rows per key; suffix sums over those give tp/fp per threshold.
    """
    g = score_counts(scored, keys).groupBy(*keys, _grid_index(F.col("prob")).alias("g")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # at most 52 rows per key: written once so the three branches below do not
    # rescan the scored rows
    g = stash(g, "grid_counts")
    grid = (g.select(*keys).distinct()
            .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(GRID_STEPS - 1))).alias("j")))
    per = grid.join(g.withColumn("j", F.col("g") - 1), [*keys, "j"], "left").fillna(0, ["pos", "neg"])
    # rows at or above threshold j have index g >= j + 1, i.e. the entries j' >= j
    # one window group per key holds exactly 51 rows
    w = Window.partitionBy(*keys).orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    above = per.select(*keys, "j", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    totals = g.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = above.join(totals, keys).select(
        *keys, ((F.lit(GRID_START) + F.col("j")) / F.lit(100.0)).alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        (F.col("P") - F.col("tp")).cast("bigint").alias("fn"),
        (F.col("N") - F.col("fp")).cast("bigint").alias("tn"))
    return rates(out)


def recall_first_threshold(sweep: DataFrame, keys=KEYS, recall_min: float = RECALL_MIN) -> DataFrame:
    """Max F1 among thresholds with recall >= floor (lowest on ties);
    otherwise max F1 overall.  One row per key with the chosen metrics."""
    meets = F.col("recall") >= F.lit(recall_min)
    w = Window.partitionBy(*keys).orderBy(F.desc(meets.cast("int")), F.desc("f1"), "threshold")
    return (sweep.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .drop("_rn").withColumnRenamed("threshold", "chosen_threshold"))


def chosen_val_metrics(scored: DataFrame, with_auc: bool = True) -> DataFrame:
    """Validation record per model: chosen threshold, its metrics and AUC."""
    val = score_counts(scored.where(F.col("split") == "val"), materialize=with_auc)
    chosen = recall_first_threshold(threshold_sweep(val))
    return chosen.join(roc_auc(val), KEYS, "left") if with_auc else chosen


def frozen_test_metrics(scored: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Each model's validation threshold applied to its test rows."""
    counts = score_counts(scored, materialize=True)
    if chosen is None:
        chosen = chosen_val_metrics(counts, with_auc=False)
    thr = chosen.select("model", F.col("chosen_threshold").alias("used_threshold"))  # a row per model
    test = counts.where(F.col("split") == "test")
    conf = rates(confusion(test.join(thr, "model"), F.col("used_threshold"), [*KEYS, "used_threshold"]))
    return conf.join(roc_auc(test), KEYS, "left")


def roc_points(scored: DataFrame, keys=KEYS, buckets: int | None = None) -> DataFrame:
    """ROC points, descending thresholds, collinear points dropped.

    A point is kept when it is the first or last distinct score, or when its
    (pos, neg) increments differ from the next score's (the second
    difference of the cumulative curve is non-zero).  The origin is added
    with a null threshold.  The next score's increments come with the running
    sums: from the next row, or from the first row of the next range.
    """
    counts = score_counts(scored, keys, materialize=True).withColumn("one", F.lit(1))
    cum = running_sums(counts, keys, "prob", ["one", "pos", "neg"], descending=True,
                       buckets=buckets, following=("pos", "neg"))
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    keep = ((F.col("cum_one") == 1) | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    pts = cum.where(keep).join(totals, keys).select(
        *keys, F.col("prob").alias("threshold"),
        F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"))
    origin = totals.select(*keys, F.lit(None).cast("double").alias("threshold"),
                           F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                           F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    return origin.unionByName(pts)


def model_ordinal(c: Column) -> Column:
    expr = None
    for i, m in enumerate(MODEL_ORDER):
        expr = F.when(c == m, i) if expr is None else expr.when(c == m, i)
    return expr.otherwise(len(MODEL_ORDER))


def winner(val_metrics: DataFrame) -> DataFrame:
    """best validation F1, first in model order on ties."""
    return (val_metrics.orderBy(F.desc("f1"), model_ordinal(F.col("model"))).limit(1))


def pretty_metrics(metrics: DataFrame, set_label: Column, thr_col: str) -> DataFrame:
    """Rounded metrics row (3 digits, threshold 2)."""
    return metrics.select(
        set_label.alias("set"), F.round("precision", 3).alias("precision"),
        F.round("recall", 3).alias("recall"), F.round("f1", 3).alias("f1"),
        F.round("auc", 3).alias("auc"), F.round(thr_col, 2).alias("threshold"),
        "tp", "fp", "tn", "fn")


def model_comparison(test_metrics: DataFrame) -> DataFrame:
    """Test metrics of every model in the fixed model order."""
    label = None
    for m, name in MODEL_LABELS.items():
        c = F.col("model") == m
        label = F.when(c, name) if label is None else label.when(c, name)
    return test_metrics.select(
        label.otherwise(F.upper("model")).alias("model_label"),
        model_ordinal(F.col("model")).alias("model_ord"),
        F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"),
        F.round("f1", 3).alias("f1"), F.round("auc", 3).alias("auc"),
        F.round("used_threshold", 2).alias("threshold")).coalesce(1).sortWithinPartitions("model_ord")


def confusion_long(test_metrics: DataFrame) -> DataFrame:
    """The 2x2 matrix per model as (model, actual, predicted, n)."""
    return test_metrics.selectExpr(
        "model", "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)")
