"""Evaluation operators against brute force and hand examples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnscope.operators import actions as ac
from churnscope.operators import evaluate as ev


def _scored(spark, y, p, model="m", split="val"):
    pdf = pd.DataFrame({"model": model, "split": split, "customerID": range(len(y)),
                        "y": np.asarray(y, dtype="int32"), "prob": np.asarray(p, dtype=float)})
    return spark.createDataFrame(pdf)


def _auc_brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_ties_and_monotone_invariance(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.random(500) * 16) / 16 * 0.5 + y * 0.2
    auc = ev.roc_auc(_scored(spark, y, p), buckets=5).first()["auc"]
    assert auc == pytest.approx(_auc_brute(y, p), abs=1e-12)
    auc2 = ev.roc_auc(_scored(spark, y, p ** 3), buckets=3).first()["auc"]
    assert auc2 == pytest.approx(auc, abs=1e-12)


def test_one_class_auc_null(spark):
    row = ev.bin_metrics(_scored(spark, [1, 1, 1], [0.2, 0.6, 0.9]), 0.5).first()
    assert row["auc"] is None and row["tp"] == 2 and row["fn"] == 1 and row["fp"] == 0


def test_golden_counts(spark):
    """Published counts: tp 307, fp 255, fn 67 -> precision .5463, recall .8209, F1 .6560."""
    row = ev.rates(spark.createDataFrame([(307, 255, 67)], "tp long, fp long, fn long")).first()
    assert [round(row[c], 4) for c in ("precision", "recall", "f1")] == [0.5463, 0.8209, 0.6560]


def test_sweep_matches_brute_force_and_recall_first(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = rng.integers(0, 101, 400) / 100.0
    sweep = ev.threshold_sweep(_scored(spark, y, p)).toPandas().sort_values("threshold")
    assert len(sweep) == 51
    for _, r in sweep.iterrows():
        pred = p >= r["threshold"]
        assert r["tp"] == ((y == 1) & pred).sum() and r["fp"] == ((y == 0) & pred).sum()
    chosen = ev.recall_first_threshold(ev.threshold_sweep(_scored(spark, y, p))).first()
    ok = sweep[sweep["recall"] >= 0.6]
    best = ok.sort_values(["f1", "threshold"], ascending=[False, True]).iloc[0]
    assert chosen["chosen_threshold"] == best["threshold"] and chosen["recall"] >= 0.6


def test_recall_fallback(spark):
    # no threshold reaches recall 0.6 -> max F1 overall
    y = [1] * 10 + [0] * 10
    p = [0.9] * 3 + [0.1] * 7 + [0.05] * 10
    chosen = ev.recall_first_threshold(ev.threshold_sweep(_scored(spark, y, p))).first()
    assert chosen["recall"] < 0.6 and chosen["chosen_threshold"] == 0.3


def test_roc_points_drop_collinear(spark):
    y = [1, 1, 0, 0, 1, 0]
    p = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
    pts = ev.roc_points(_scored(spark, y, p), buckets=3).toPandas()
    pts = pts.sort_values(["fpr", "tpr"])
    got = list(zip(pts["fpr"].round(6), pts["tpr"].round(6)))
    # tps 1,2,2,2,3,3 / fps 0,0,1,2,2,3: the second differences drop only the
    # third score, so (0,0) (0,1/3) (0,2/3) (2/3,2/3) (2/3,1) (1,1) remain
    assert got == [(0.0, 0.0), (0.0, 0.333333), (0.0, 0.666667), (0.666667, 0.666667),
                   (0.666667, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("p,risk,conf", [(0.3, "Low", "Medium"), (0.4, "Medium", "Low"),
                                         (0.5, "Medium", "Low"), (0.7, "High", "Low"),
                                         (0.8, "High", "High"), (0.0, "Low", "High"),
                                         (1.0, "High", "High")])
def test_risk_and_confidence(spark, p, risk, conf):
    row = spark.range(1).select(ac.risk_bucket(F.lit(p)).alias("r"),
                                ac.confidence(F.lit(p)).alias("c")).first()
    assert row["r"] == risk and row["c"] == conf


def test_recommendations(spark):
    row = spark.range(1).select(
        ac.recommendations(F.lit("High"), F.lit("Premium"), F.lit("No"),
                           F.lit("Electronic check")).alias("r"),
        ac.priority(F.lit("High"), F.lit("Premium")).alias("p")).first()
    assert len(row["r"]) == 6 and row["r"][-1].startswith("Suggest Auto-Pay")
    assert row["p"].startswith("HIGH PRIORITY")
