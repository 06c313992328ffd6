"""Exact quantiles, quartile tiers, splits and running sums (property checks)."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnscope.operators import reports as rp
from churnscope.operators.ranking import running_sums
from churnscope.operators.split import stratified_split
from churnscope.operators.stats import exact_quantiles, exact_quantiles_multi


def test_exact_quantiles_small_and_bracketed(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])  # a hot value
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    expect = np.quantile(vals, probs)
    small = exact_quantiles(df, "x", probs)
    # a coarse approximation and many ranges
    brack = exact_quantiles(df, "x", probs, accuracy=100, buckets=16)
    assert np.allclose(small, expect, rtol=0, atol=1e-12)
    assert np.allclose(brack, expect, rtol=0, atol=1e-12)
    multi = exact_quantiles_multi(df.withColumn("y", F.col("x") * 2), {"x": [0.5], "y": [0.25]})
    assert multi["x"][0] == pytest.approx(np.quantile(vals, 0.5), abs=1e-12)
    assert multi["y"][0] == pytest.approx(np.quantile(vals * 2, 0.25), abs=1e-12)


def test_quartile_edges_right_vs_left_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9]], "CLV double")
    edges = exact_quantiles(df, "CLV", [0.25, 0.5, 0.75])
    assert edges == [3.0, 5.0, 7.0]
    q = {r["CLV"]: r["CLV_quartile"] for r in rp.add_clv_quartile(df, edges=edges).collect()}
    s = {r["CLV"]: r["clv_segment"] for r in rp.clv_segment(df, edges).collect()}
    assert q[3.0] == "Low" and s[3.0] == "Medium"      # a value on q1
    assert q[1.0] == "Low" and q[9.0] == "Premium"


def test_collapsed_edges_raise(spark):
    df = spark.createDataFrame([(5.0,)] * 8, "CLV double")
    with pytest.raises(ValueError):
        rp.add_clv_quartile(df)


def test_stratified_split_shares(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "customerID long, ChurnFlag int")
    out = stratified_split(df).groupBy("ChurnFlag", "split").count().collect()
    got = {(r["ChurnFlag"], r["split"]): r["count"] for r in out}
    assert got[(1, "train")] == 300 and got[(1, "val")] == 100 and got[(1, "test")] == 100
    assert got[(0, "train")] == 900 and got[(0, "val")] == 300 and got[(0, "test")] == 300


def test_split_does_not_depend_on_the_number_of_ranges(spark):
    rows = [(f"id-{i}", 1 if i % 3 == 0 else 0) for i in range(3000)] + [("twice", 1), ("twice", 1), (None, 0)]
    df = spark.createDataFrame(rows, "customerID string, ChurnFlag int")
    first, *others = [Counter(map(tuple, stratified_split(df, buckets=b).collect())) for b in (1, 8, 64)]
    assert all(first == o for o in others) and sum(first.values()) == len(rows)


def test_running_sums_match_cumsum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000), "x": rng.random(3000),
                        "v": rng.integers(0, 5, 3000)})
    pdf = pdf.drop_duplicates(["k", "x"])
    df = spark.createDataFrame(pdf)
    for desc in (False, True):
        got = running_sums(df, ["k"], "x", ["v"], descending=desc, buckets=7).toPandas()
        exp = pdf.sort_values(["k", "x"], ascending=[True, not desc])
        exp["cum_v"] = exp.groupby("k")["v"].cumsum()
        m = exp.merge(got, on=["k", "x"], suffixes=("", "_s"))
        assert len(m) == len(pdf) and (m["cum_v"] == m["cum_v_s"]).all()


@pytest.mark.parametrize("buckets", [2000, 10000])
def test_running_sums_with_many_ranges(spark, buckets):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": np.repeat([0, 1], 3000), "x": np.concatenate([rng.random(3000), 0.5 + rng.random(3000) / 1e6]),
                        "v": rng.integers(0, 5, 6000)}).drop_duplicates(["k", "x"])
    df = spark.createDataFrame(pdf)
    sums = [running_sums(df, ["k"], "x", ["v"], descending=True, buckets=b, following=("v",))
            .orderBy("k", "x").toPandas() for b in (8, buckets)]
    assert sums[0].equals(sums[1]) and len(sums[0]) == len(pdf)
    for _, part in sums[0].groupby("k"):
        assert part["v"].iloc[:-1].tolist() == part["next_v"].iloc[1:].astype(int).tolist()
        assert np.isnan(part["next_v"].iloc[0])


def test_quantiles_of_large_and_empty_columns(spark):
    rng = np.random.default_rng(21)
    vals = rng.random(20000)
    df = spark.createDataFrame(pd.DataFrame({"x": vals, "one": 3.0})).withColumn("none", F.lit(None).cast("double"))
    got = exact_quantiles_multi(df, {"x": [0.5, 0.9], "one": [0.1], "none": [0.5]}, accuracy=50)
    assert np.allclose(got["x"], np.quantile(vals, [0.5, 0.9]), rtol=0, atol=1e-15)
    assert got["one"] == [3.0] and got["none"] == [None]
