"""Fitted-model operators: rows-only properties (no exact oracle exists)."""

import numpy as np
from pyspark.sql import functions as F

from churnscope.operators import evaluate as ev
from churnscope.operators import explain as xp
from churnscope.operators import ml
from churnscope.plans.prep import model_table, train_only
from churnscope.sources.subscribers import load_subscribers
from tests.conftest import SF_SMALL


def test_logreg_fit_names_and_scores(spark):
    prepared = model_table(load_subscribers(spark, SF_SMALL))
    train = train_only(prepared)
    d = xp.fit_design(train)
    model = ml.fit_model("logreg", train, d)
    names = [r.feature for r in xp.feature_table(d).orderBy("position").collect()]
    levels = {c: sorted({str(r[0]) if r[0] is not None else "nan" for r in train.select(c).distinct().collect()})
              for c in d.categorical}
    assert names == [f"num__{c}" for c in d.numeric] + [f"cat__{c}_{v}" for c in levels for v in levels[c]]
    assert len(model.stages[-1].coefficients) == len(names) == d.width
    scored = ml.score(model, prepared.where(F.col("split") != "train"), d, "logreg")
    rows = scored.collect()
    assert rows and all(0.0 <= r["prob"] <= 1.0 for r in rows)
    assert ev.frozen_test_metrics(scored).count() == 1


def test_train_and_evaluate_writes_artifacts(spark):
    import os
    import tempfile
    from churnscope.plans.train import train_and_evaluate
    from churnscope.sources import artifacts as art
    prepared = model_table(load_subscribers(spark, SF_SMALL))
    out = tempfile.mkdtemp(prefix="train-", dir="/tmp")
    res = train_and_evaluate(prepared, kinds=("logreg",), out_dir=out)
    assert res.winner == "logreg"
    metrics = art.read_metrics(spark, os.path.join(out, "metrics_all"))
    assert metrics.count() == 2
    thr = art.operating_threshold(art.read_metrics(spark, os.path.join(out, "best_metrics"))).first()
    assert 0.3 <= thr["operating_threshold"] <= 0.8
    assert art.read_importance(spark, os.path.join(out, "importance"), "logreg").count() == 40
    assert art.read_drivers_csv(spark, os.path.join(out, "drivers_full")).count() >= 30
    model = art.load_pipeline(os.path.join(out, "pipelines", "best"))
    holdout = prepared.where(F.col("split") != "train")
    again = ml.score(model, holdout, art.load_design(spark, os.path.join(out, "pipelines", "design")), "logreg")
    assert again.count() == holdout.count() and again.exceptAll(res.scored.select(again.columns)).count() == 0
    assert art.read_roc(spark, os.path.join(out, "roc_test"), "logreg").count() >= 2
    from churnscope.plans.train import retention_with_model
    from churnscope.sources.subscribers import load_subscribers as _load
    ret = retention_with_model(_load(spark, SF_SMALL), prepared.where(F.col("split") == "train"), res)
    rows = ret.collect()
    assert len(rows) == prepared.count()
    assert all(0.0 <= r["prob"] <= 1.0 and r["risk"] in ("High", "Medium", "Low") for r in rows)


def test_logreg_matches_newton_solver(spark):
    """MLlib's fit equals a NumPy Newton solve of the reference objective
    C * sum(w_i * logloss_i) + |beta|^2 / 2 (intercept unpenalised, balanced w)."""
    prepared = model_table(load_subscribers(spark, SF_SMALL))
    train = train_only(prepared)
    d = xp.fit_design(train)
    model = ml.fit_model("logreg", train, d)
    rows = (model.transform(ml.design_vectors(train, d))
            .select("features", "ChurnFlag", "probability").collect())
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["ChurnFlag"] for r in rows], dtype=float)
    p_spark = np.array([r["probability"][1] for r in rows])
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    Xb = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(Xb.shape[1])
    reg = np.ones(Xb.shape[1])
    reg[-1] = 0.0                                  # no penalty on the intercept
    for _ in range(100):
        p = 1 / (1 + np.exp(-Xb @ beta))
        grad = Xb.T @ (w * (p - y)) + reg * beta
        hess = (Xb * (w * p * (1 - p))[:, None]).T @ Xb + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    p_newton = 1 / (1 + np.exp(-Xb @ beta))
    assert np.abs(p_newton - p_spark).max() < 1e-3


def test_vectors_of_odd_rows(spark):
    """Nulls, levels unseen in training, repeated rows and a constant numeric."""
    schema = "customerID string, x double, z int, a string, b string, ChurnFlag int"
    train = spark.createDataFrame([("1", 1.0, 5, "u", None, 1), ("2", 3.0, 5, "v", "p q", 0),
                                   ("3", None, 5, None, "p q", 0)], schema)
    d = xp.fit_design(train, ["x", "z"], ["a", "b"])
    assert d.sizes == {"a": 3, "b": 2} and d.width == 7
    names = [r.feature for r in xp.feature_table(d).orderBy("position").collect()]
    assert names == ["num__x", "num__z", "cat__a_nan", "cat__a_u", "cat__a_v", "cat__b_nan", "cat__b_p q"]
    odd = spark.createDataFrame([("4", 2.0, 6, "new", None, 1), ("4", 2.0, 6, "new", None, 1),
                                 ("5", None, 5, "v", "", None)], schema)
    got = sorted((r.customerID, str(r.features.toArray().tolist())) for r in ml.design_vectors(odd, d).collect())
    assert got == [("4", "[0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]")] * 2 + [("5", "[nan, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]")]
    none = xp.fit_design(train.limit(0), ["x", "z"], ["a", "b"])
    assert none.width == 2 and none.levels.count() == 0
    assert ml.design_vectors(odd, none, "customerID").count() == 3


def test_a_million_levels(spark):
    """Positions are those of the sorted levels; the vocabulary is joined, not held by the driver."""
    n = 1_000_000
    train = spark.range(n).select(
        F.col("id").cast("string").alias("customerID"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") * 7919 % n)).alias("a"),
        F.lit("one").alias("b"), (F.col("id") % 2).cast("int").alias("ChurnFlag"))
    d = xp.fit_design(train, ["x"], ["a", "b"])
    levels = n - (n + 2) // 3 + 1
    assert d.sizes == {"a": levels, "b": 1} and d.width == levels + 2
    ranks = d.levels.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(ranks) == (1, levels + 1, levels + 1)
    ordered = d.levels.where("column = 'a' AND position <= 500 OR level = 'hot'").orderBy("position").collect()
    expected = sorted({f"v{i * 7919 % n}" for i in range(n) if i % 3} | {"hot"})
    assert [r.level for r in ordered] == expected[:500] and ordered[0].level == "hot"
    rows = ml.design_vectors(train, d, "customerID")
    plan = spark._jvm.PythonSQLUtils.explainString(
        xp.join_levels(train, d, d.levels, "position")._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in plan and rows.count() == n
    some = rows.where("customerID IN ('0', '3', '1')").collect()
    at = {v: i + 1 for i, v in enumerate(expected)}
    assert {r.customerID: sorted(map(int, r.features.indices)) for r in some} == {
        "0": [0, at["hot"], levels + 1], "3": [0, at["hot"], levels + 1], "1": [0, at["v7919"], levels + 1]}


def test_certificate_falls_with_a_wrong_model(spark):
    """Scores that order rows like the target beat the fixture's scorers; turned around or constant ones do not."""
    from churnscope.plans.catalog import beats_fixture
    rows = [(str(i), i % 3 == 0, (i * 7) % 10) for i in range(90)]
    schema = "model string, split string, customerID string, y int, prob double"
    table = lambda f: spark.createDataFrame([("rf", "train", c, int(y), f(y, n)) for c, y, n in rows], schema)
    fixture = table(lambda y, n: n / 10)
    assert beats_fixture(table(lambda y, n: 0.5 * y + n / 20), fixture).first()["beats_fixture"]
    assert not beats_fixture(table(lambda y, n: 1 - 0.5 * y - n / 20), fixture).first()["beats_fixture"]
    better = table(lambda y, n: 0.25 * y + n / 20)
    assert not beats_fixture(table(lambda y, n: 0.5), better).first()["beats_fixture"]  # an AUC of one half


def test_vectors_of_a_large_table_are_dealt_to_every_core(spark):
    """Passes over vectors from one file would all wait for one task; a few rows stay where they are."""
    rows = spark.range(ml.DEAL_ROWS).coalesce(1).select(
        F.col("id").alias("customerID"), (F.col("id") % 3 == 0).cast("int").alias(ml.TARGET),
        (F.col("id") % 72).cast("int").alias("tenure"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("Contract"))
    d = xp.fit_design(rows, ["tenure"], ["Contract"])
    vectors = ml.design_vectors(rows, d)
    files = [r["count"] for r in vectors.groupBy(F.input_file_name()).count().collect()]
    assert len(files) >= spark.sparkContext.defaultParallelism and max(files) <= 1.2 * min(files)
    assert vectors.drop("features").exceptAll(rows).isEmpty() and vectors.count() == ml.DEAL_ROWS
    few = ml.design_vectors(rows.limit(100), xp.fit_design(rows.limit(100), ["tenure"], ["Contract"]))
    assert few.select(F.input_file_name()).distinct().count() == 1
