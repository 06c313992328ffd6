"""Report operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from churnscope.operators import reports as rp


@pytest.fixture()
def tiers(spark):
    # CLV 1..8, churn only in the top values; edges 2.75 / 4.5 / 6.25
    rows = [(float(v), 1 if v >= 7 else 0) for v in range(1, 9)]
    return spark.createDataFrame(rows, "CLV double, ChurnFlag int")


def test_quartile_report_and_narrative_tables(spark, tiers):
    q = rp.add_clv_quartile(tiers)
    summary = rp.churn_rate_by_quartile(q)
    rows = summary.collect()
    assert [r["CLV_quartile"] for r in rows] == ["Low", "Medium", "High", "Premium"]
    assert [r["size"] for r in rows] == [2, 2, 2, 2]
    gap = rp.quartile_gap(summary).first()
    assert gap["diff_pp"] == 100.0 and gap["direction"] == "higher"
    assert rp.worst_segment(summary).first()["CLV_quartile"] == "Premium"
    top = [r["CLV_quartile"] for r in rp.top_segments(summary).collect()]
    assert top == ["Premium", "Low"]                      # ties at 0 -> lowest tier first
    shares = {r["CLV_quartile"]: r["share_pct"] for r in rp.segment_share(summary).collect()}
    assert shares == {"Low": 25.0, "Medium": 25.0, "High": 25.0, "Premium": 25.0}


def test_empty_tier_kept(spark, tiers):
    q = rp.add_clv_quartile(tiers).where(F.col("CLV_quartile") != "Medium")
    rows = {r["CLV_quartile"]: r for r in rp.churn_rate_by_quartile(q).collect()}
    assert rows["Medium"]["size"] == 0 and rows["Medium"]["churn_rate"] is None


def test_histogram_covers_range(spark, tiers):
    h = sorted(rp.histogram(tiers, "CLV", 30).collect(), key=lambda r: r["bin"])
    assert len(h) == 30 and sum(r["customers"] for r in h) == 8
    assert h[-1]["customers"] == 1 and h[0]["bin_lo"] == 1.0 and h[-1]["bin_hi"] == 8.0


def test_insights_nan_when_absent(spark):
    df = spark.createDataFrame(
        [("Month-to-month", "Electronic check", "DSL", "No", 100.0, 1),
         ("Month-to-month", "Credit card (automatic)", "DSL", "Yes", 200.0, 0),
         ("Month-to-month", None, "No", "No internet service", 300.0, 0),
         ("Month-to-month", "Mailed check", "Fiber optic", "No", 400.0, 1)],
        "Contract string, PaymentMethod string, InternetService string, TechSupport string, "
        "CLV double, ChurnFlag int")
    r = rp.business_insights(df).first()
    assert r["contract_month_to_month"] == 0.5 and r["contract_two_year"] is None
    assert r["autopay_auto"] == 0.0 and r["autopay_manual"] == 2 / 3
    assert r["tech_no_support"] == 1.0 and r["tech_support"] == 0.0


def test_reports_of_one_plan_equal_the_single_ones(spark):
    df = spark.createDataFrame(
        [("Low", "Month-to-month", "Electronic check", "DSL", "No", 1),
         ("Low", None, "Credit card (automatic)", "DSL", "Yes", 0),
         (None, "One year", None, "No", "No internet service", 0),
         ("High", "One year", "Mailed check", "Fiber optic", "No", None)],
        "CLV_quartile string, Contract string, PaymentMethod string, InternetService string, TechSupport string, "
        "ChurnFlag int")
    out = rp.churn_reports(df)
    rows = {(r.report, r.level): (r.customers, r.labelled, r.churn_rate) for r in out.collect()}
    for report, single in {"contract": rp.churn_by(df, "Contract", "level"),
                           "payment": rp.churn_by(df, "PaymentMethod", "level"),
                           "autopay": rp.churn_by_autopay(df).withColumnRenamed("autopay", "level")}.items():
        expected = {str(r.level).lower() if report == "autopay" else r.level: (r.customers, r.churn_rate)
                    for r in single.collect()}
        assert {lv: (v[0], v[2]) for (name, lv), v in rows.items() if name == report} == expected
    assert rows["quartile", "Low"] == (2, 2, 0.5) and rows["quartile", "High"] == (1, 0, None)
    assert rows["support", "no"] == (2, 1, 1.0) and rows["support", "yes"] == (1, 1, 0.0)
    assert ("contract", None) not in rows and len(rows) == 11
    plan = spark._jvm.PythonSQLUtils.explainString(rp.churn_reports(df)._jdf.queryExecution(), "simple")
    assert plan.count("Expand") == 1 and plan.count("Exchange") == 1
    assert rp.churn_reports(df.limit(0)).count() == 0
