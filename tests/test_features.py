"""Cleaning and feature semantics on hand-made edge rows."""

import pytest

from churnscope.functions.features import NUMERIC_FEATURES
from churnscope.operators.clean import clean_total_charges
from churnscope.operators.features import add_clv, engineer_features, serving_features
from churnscope.operators.stats import FeatureStats
from tests.conftest import make_raw


def test_total_charges_coercion(spark):
    raw = make_raw(spark, [
        {"tenure": 0, "TotalCharges": " "},
        {"tenure": 5, "MonthlyCharges": 20.0, "TotalCharges": ""},
        {"tenure": 3, "TotalCharges": "1d"},          # not numeric text for pandas
        {"tenure": 2, "TotalCharges": " 12.5\t"},     # padded number parses
        {"tenure": None, "TotalCharges": "abc"},      # leftover -> median
        {"tenure": 4, "TotalCharges": "100"},
    ])
    out = {int(r["customerID"]): r["TotalCharges"] for r in clean_total_charges(raw).collect()}
    assert out[1] == 0.0
    assert out[2] == 100.0
    assert out[3] == 150.0  # tenure 3 x 50.0: '1d' is not accepted as a number
    assert out[4] == 12.5
    assert out[6] == 100.0
    # median of the filled values 0, 100, 150, 12.5, 100 -> 100
    assert out[5] == 100.0


def _feats(spark, rows, stats=FeatureStats(0.1, 50.0)):
    return {int(r["customerID"]): r for r in
            engineer_features(add_clv(clean_total_charges(make_raw(spark, rows))), stats).collect()}


def test_null_internet_counts_as_on(spark):
    f = _feats(spark, [{"InternetService": None, "TechSupport": "No"},
                       {"InternetService": "  Fiber Optic ", "SeniorCitizen": 1}])
    assert f[1]["internet_no_tech_support"] == 1      # null != 'no' is True in pandas
    assert f[1]["is_fiber_optic"] == 0
    assert f[2]["is_fiber_optic"] == 1 and f[2]["senior_fiber_optic"] == 1


@pytest.mark.parametrize("tenure,bucket,ordinal", [
    (0, "0-6m", 0), (6, "0-6m", 0), (7, "6-12m", 1), (12, "6-12m", 1), (13, "12-24m", 2),
    (24, "12-24m", 2), (25, "24m+", 3), (72, "24m+", 3), (-1, None, 0)])
def test_tenure_bucket_right_closed(spark, tenure, bucket, ordinal):
    f = _feats(spark, [{"tenure": tenure, "TotalCharges": "10"}])[1]
    assert f["tenure_bucket"] == bucket and f["tenure_bucket_ord"] == ordinal


def test_zero_charges_and_unknown_contract(spark):
    f = _feats(spark, [{"MonthlyCharges": 0.0, "tenure": 0, "TotalCharges": " ",
                        "Contract": "Weekly"},
                       {"Contract": "  month-to-MONTH ", "tenure": 2, "MonthlyCharges": 10.0,
                        "TotalCharges": "20"}])
    assert f[1]["CLV"] == 0.0 and f[1]["ExpectedTenure"] == 6
    assert f[1]["monthly_to_total_ratio"] == 0.0 and f[1]["remaining_value_ratio"] == 0.0
    assert f[2]["ExpectedTenure"] == 6 and f[2]["is_long_contract"] == 0
    assert f[2]["tenure_remaining"] == 4


def test_median_flags_ge(spark):
    f = _feats(spark, [{"MonthlyCharges": 50.0}, {"MonthlyCharges": 49.75}],
               FeatureStats(1 / 6, 50.0))
    assert f[1]["high_monthly_charge"] == 1 and f[2]["high_monthly_charge"] == 0
    assert f[1]["high_charge_to_clv_ratio"] == 1   # 50 / 300 == 1/6 exactly


def test_serving_presets(spark):
    """The scoring page's two presets go through the serving definition."""
    raw = make_raw(spark, [
        {"tenure": 2, "MonthlyCharges": 105.0, "Contract": "Month-to-month",
         "InternetService": "Fiber optic", "PaymentMethod": "Electronic check",
         "SeniorCitizen": 1, "PaperlessBilling": "Yes", "PhoneService": "No",
         "MultipleLines": "No phone service"},
        {"tenure": 24, "MonthlyCharges": 60.0, "Contract": "Two year",
         "InternetService": "DSL", "PaymentMethod": "Bank transfer (automatic)",
         "TechSupport": "Yes", "OnlineSecurity": "Yes"},
    ])
    out = {int(r["customerID"]): r for r in serving_features(raw, FeatureStats(0.1, 70.0)).collect()}
    hi, lo = out[1], out[2]
    assert hi["TotalCharges"] == 210.0 and hi["CLV"] == 630.0 and hi["senior_fiber_optic"] == 1
    assert hi["services_count"] == 1 and hi["internet_no_tech_support"] == 1
    assert lo["CLV"] == 1440.0 and lo["is_auto_pay"] == 1 and lo["is_long_contract"] == 1
    assert lo["tenure_remaining"] == 0 and lo["tenure_fraction_complete"] == 1.0
    assert set(NUMERIC_FEATURES) <= set(out[1].asDict())


def test_required_columns(spark):
    raw = make_raw(spark, [{}]).drop("Contract")
    with pytest.raises(ValueError):
        add_clv(raw)
