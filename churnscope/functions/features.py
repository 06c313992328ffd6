"""Feature expressions as plain Column functions.

Two definitions exist in the reference: the training one (data preparation)
and the serving one (the scoring form).  Both are here; ``training_*`` and
``serving_*`` builders return ordered ``(name, Column)`` lists that a single
``select`` applies.  Dependent features refer to earlier output names, so
operators apply the lists in stages (Catalyst collapses the projections).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnscope.functions.text import (at_least, clip_lower, clip_upper, col, eq_lower,
                                       eq_norm, flag, is_yes, ne_lower, nonzero, norm)

# Fixed values that must equal the reference's for right results.
EXPECTED_TENURE_BY_CONTRACT = {"month-to-month": 6, "one year": 12, "two year": 24}
EXPECTED_TENURE_SERVING = {"Month-to-month": 6, "One year": 12, "Two year": 24}
DEFAULT_EXPECTED_TENURE = 6
TENURE_BUCKET_LABELS = ["0-6m", "6-12m", "12-24m", "24m+"]
TENURE_BUCKET_EDGES = [-0.1, 6, 12, 24]  # right-closed bins, last one open-ended
AUTOPAY_METHODS = ["bank transfer (automatic)", "credit card (automatic)"]
AUTOPAY_METHODS_SERVING = ["Bank transfer (automatic)", "Credit card (automatic)"]
SERVICE_COLUMNS = ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
                   "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
STREAMING_COLUMNS = ["StreamingTV", "StreamingMovies"]
SUPPORT_COLUMNS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport"]
FRACTION_CAP = 5.0

NUMERIC_FEATURES = [
    "tenure", "MonthlyCharges", "TotalCharges", "CLV", "services_count",
    "monthly_to_total_ratio", "internet_no_tech_support", "tenure_bucket_ord",
    "is_auto_pay", "is_long_contract", "streaming_services", "support_services",
    "senior_fiber_optic", "charges_per_month_of_tenure", "high_charge_to_clv_ratio",
    "tenure_years", "per_service_charge", "is_fiber_optic", "has_streaming_any",
    "has_support_any", "has_multiple_lines_yes", "is_electronic_check",
    "paperless_autopay", "family_bundle", "early_tenure_flag", "high_monthly_charge",
    "tenure_remaining", "tenure_fraction_complete", "remaining_value",
    "remaining_value_ratio",
]
CATEGORICAL_FEATURES = [
    "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod", "tenure_bucket",
]
TARGET = "ChurnFlag"


def _map_lookup(key: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v)))
    return expr


# ---- C1 / C2 ---------------------------------------------------------------

def expected_tenure(contract="Contract") -> Column:
    """Contract -> 6/12/24 months (stripped, lower-cased); unknown -> 6."""
    return F.coalesce(_map_lookup(norm(contract), EXPECTED_TENURE_BY_CONTRACT),
                      F.lit(DEFAULT_EXPECTED_TENURE)).cast("int")


def expected_tenure_serving(contract="Contract") -> Column:
    """C1 as the scoring form does it: exact labels, unknown -> 6."""
    return F.coalesce(_map_lookup(col(contract), EXPECTED_TENURE_SERVING),
                      F.lit(DEFAULT_EXPECTED_TENURE)).cast("int")


def clv(monthly="MonthlyCharges", expected="ExpectedTenure") -> Column:
    """MonthlyCharges x ExpectedTenure."""
    return (col(monthly) * col(expected)).cast("double")


# ---- C3 / C4 ---------------------------------------------------------------

def tenure_bucket(tenure="tenure") -> Column:
    """Right-closed bins (-0.1,6] (6,12] (12,24] (24,inf); else null."""
    t = col(tenure)
    lo, b1, b2, b3 = TENURE_BUCKET_EDGES
    return (F.when((t > lo) & (t <= b1), TENURE_BUCKET_LABELS[0])
            .when((t > b1) & (t <= b2), TENURE_BUCKET_LABELS[1])
            .when((t > b2) & (t <= b3), TENURE_BUCKET_LABELS[2])
            .when(t > b3, TENURE_BUCKET_LABELS[3]))


def tenure_bucket_serving(tenure="tenure") -> Column:
    """C3 as the form does it: plain <= chain, every tenure gets a label."""
    t = col(tenure)
    return (F.when(t <= 6, TENURE_BUCKET_LABELS[0]).when(t <= 12, TENURE_BUCKET_LABELS[1])
            .when(t <= 24, TENURE_BUCKET_LABELS[2]).otherwise(TENURE_BUCKET_LABELS[3]))


def tenure_bucket_ord(bucket="tenure_bucket") -> Column:
    """C4: ordinal 0-3, null -> 0."""
    b = col(bucket)
    expr = None
    for i, label in enumerate(TENURE_BUCKET_LABELS):
        expr = F.when(b == label, i) if expr is None else expr.when(b == label, i)
    return F.coalesce(expr, F.lit(0)).cast("int")


# ---- training definition ---------------------------------------------------

def internet_on(c="InternetService") -> Column:
    """``InternetService.str.lower() != 'no'``: null counts as on."""
    return ne_lower(c, "no")


def count_yes(columns) -> Column:
    total = None
    for c in columns:
        term = flag(is_yes(c))
        total = term if total is None else total + term
    return total.cast("int")


def training_stage1() -> list[tuple[str, Column]]:
    """Features that only need raw columns, ExpectedTenure and CLV."""
    autopay = flag(norm("PaymentMethod").isin(AUTOPAY_METHODS))
    return [
        ("tenure_bucket", tenure_bucket()),
        ("services_count", (count_yes(SERVICE_COLUMNS) + flag(internet_on())).cast("int")),
        ("monthly_to_total_ratio",
         F.col("TotalCharges") / nonzero(F.col("tenure") * F.col("MonthlyCharges"))),
        ("internet_no_tech_support",
         flag(internet_on() & eq_lower("TechSupport", "no"))),
        ("is_auto_pay", autopay),
        ("is_long_contract",
         flag(F.coalesce(F.lower(F.col("Contract")).contains("year"), F.lit(False)))),
        ("streaming_services", count_yes(STREAMING_COLUMNS)),
        ("support_services", count_yes(SUPPORT_COLUMNS)),
        ("senior_fiber_optic",
         flag(F.coalesce(F.col("SeniorCitizen") == 1, F.lit(False))
              & eq_norm("InternetService", "fiber optic"))),
        ("charges_per_month_of_tenure", F.col("TotalCharges") / nonzero("tenure")),
        ("clv_ratio", F.col("MonthlyCharges") / nonzero("CLV")),
        ("tenure_years", F.col("tenure") / F.lit(12.0)),
        ("is_fiber_optic", flag(eq_norm("InternetService", "fiber optic"))),
        ("has_multiple_lines_yes", flag(eq_norm("MultipleLines", "yes"))),
        ("is_electronic_check",
         flag(norm(F.coalesce(F.col("PaymentMethod"), F.lit(""))) == "electronic check")),
        ("family_bundle",
         flag((norm(F.coalesce(F.col("Partner"), F.lit(""))) == "yes")
              | (norm(F.coalesce(F.col("Dependents"), F.lit(""))) == "yes"))),
        ("early_tenure_flag", flag(F.coalesce(F.col("tenure") <= 6, F.lit(False)))),
        ("tenure_remaining",
         clip_lower(F.col("ExpectedTenure") - F.col("tenure"), 0).cast("int")),
        ("tenure_fraction_complete",
         clip_upper(F.col("tenure") / nonzero("ExpectedTenure"), FRACTION_CAP)),
        ("remaining_value", clip_lower(F.col("CLV") - F.col("TotalCharges"), 0.0)),
        (TARGET, flag(eq_norm("Churn", "yes"))),
    ]


def training_stage2(ratio_median: Column, monthly_median: Column) -> list[tuple[str, Column]]:
    """Features that need stage-1 outputs or dataset medians."""
    paperless = norm(F.coalesce(F.col("PaperlessBilling"), F.lit(""))) == "yes"
    return [
        ("tenure_bucket_ord", tenure_bucket_ord()),
        ("high_charge_to_clv_ratio",
         flag(F.coalesce(F.col("clv_ratio") >= ratio_median, F.lit(False)))),
        ("per_service_charge", F.col("MonthlyCharges") / nonzero("services_count")),
        ("has_streaming_any", flag(F.col("streaming_services") > 0)),
        ("has_support_any", flag(F.col("support_services") > 0)),
        ("paperless_autopay", flag(paperless & (F.col("is_auto_pay") == 1))),
        ("high_monthly_charge",
         flag(F.coalesce(F.col("MonthlyCharges") >= monthly_median, F.lit(False)))),
        ("remaining_value_ratio", F.col("remaining_value") / nonzero("CLV")),
    ]


# ---- serving definition (the scoring form) --------------------------------

def serving_inputs() -> list[tuple[str, Column]]:
    """Form fields read from a raw subscriber row (toggles are 'Yes' tests)."""
    def on(c):
        return F.coalesce(F.col(c) == "Yes", F.lit(False))
    return [
        ("f_phone", on("PhoneService")), ("f_onsec", on("OnlineSecurity")),
        ("f_onbak", on("OnlineBackup")), ("f_devprot", on("DeviceProtection")),
        ("f_techsup", on("TechSupport")), ("f_stv", on("StreamingTV")),
        ("f_smov", on("StreamingMovies")), ("f_paperless", on("PaperlessBilling")),
        ("f_partner", on("Partner")), ("f_dependents", on("Dependents")),
        ("f_senior", F.coalesce(F.col("SeniorCitizen") == 1, F.lit(False))),
        ("f_internet", F.coalesce(F.col("InternetService"), F.lit("No"))),
        ("f_contract", F.coalesce(F.col("Contract"), F.lit(""))),
        ("f_payment", F.coalesce(F.col("PaymentMethod"), F.lit(""))),
        ("f_multiline", F.coalesce(F.col("MultipleLines"), F.lit(""))),
    ]


def serving_payload() -> list[tuple[str, Column]]:
    """The categorical columns as the form sends them, from the form fields."""
    toggles = {"Partner": "f_partner", "Dependents": "f_dependents", "PhoneService": "f_phone",
               "OnlineSecurity": "f_onsec", "OnlineBackup": "f_onbak", "DeviceProtection": "f_devprot",
               "TechSupport": "f_techsup", "StreamingTV": "f_stv", "StreamingMovies": "f_smov",
               "PaperlessBilling": "f_paperless"}
    chosen = {"MultipleLines": "f_multiline", "InternetService": "f_internet", "Contract": "f_contract",
              "PaymentMethod": "f_payment"}
    return ([(name, F.when(F.col(f), "Yes").otherwise("No")) for name, f in toggles.items()]
            + [(name, F.col(f)) for name, f in chosen.items()]
            + [("SeniorCitizen", flag(F.col("f_senior")))])


def serving_stage1() -> list[tuple[str, Column]]:
    t, m = F.col("tenure"), F.col("MonthlyCharges")
    services = (flag(F.col("f_phone")) + flag(F.col("f_internet") != "No")
                + flag(F.col("f_onsec")) + flag(F.col("f_onbak")) + flag(F.col("f_devprot"))
                + flag(F.col("f_techsup")) + flag(F.col("f_stv")) + flag(F.col("f_smov")))
    return [
        ("TotalCharges", F.when(t > 0, m * t).otherwise(F.lit(0.0)).cast("double")),
        ("ExpectedTenure", expected_tenure_serving("f_contract")),
        ("services_count", services.cast("int")),
        ("internet_no_tech_support",
         flag((F.col("f_internet") != "No") & ~F.col("f_techsup"))),
        ("tenure_bucket", tenure_bucket_serving()),
        ("is_auto_pay", flag(F.col("f_payment").isin(AUTOPAY_METHODS_SERVING))),
        ("is_long_contract", flag(F.lower(F.col("f_contract")).contains("year"))),
        ("streaming_services", (flag(F.col("f_stv")) + flag(F.col("f_smov"))).cast("int")),
        ("support_services", (flag(F.col("f_onsec")) + flag(F.col("f_onbak"))
                              + flag(F.col("f_devprot")) + flag(F.col("f_techsup"))).cast("int")),
        ("senior_fiber_optic",
         flag(F.col("f_senior") & (F.lower(F.col("f_internet")) == "fiber optic"))),
        ("tenure_years", t / F.lit(12.0)),
        ("is_fiber_optic", flag(F.lower(F.col("f_internet")) == "fiber optic")),
        ("has_multiple_lines_yes", flag(norm("f_multiline") == "yes")),
        ("is_electronic_check", flag(norm("f_payment") == "electronic check")),
        ("family_bundle", flag(F.col("f_partner") | F.col("f_dependents"))),
        ("early_tenure_flag", flag(t <= 6)),
    ]


def serving_stage2(ratio_median: Column, monthly_median: Column) -> list[tuple[str, Column]]:
    t, m = F.col("tenure"), F.col("MonthlyCharges")
    return [
        ("CLV", clv(m, "ExpectedTenure")),
        ("monthly_to_total_ratio", F.col("TotalCharges") / at_least(t * m, 1.0)),
        ("tenure_bucket_ord", tenure_bucket_ord()),
        ("charges_per_month_of_tenure", F.col("TotalCharges") / at_least(t, 1)),
        ("per_service_charge", m / at_least("services_count", 1)),
        ("has_streaming_any", flag(F.col("streaming_services") > 0)),
        ("has_support_any", flag(F.col("support_services") > 0)),
        ("paperless_autopay", flag(F.col("f_paperless") & (F.col("is_auto_pay") == 1))),
        ("tenure_remaining", F.greatest(F.col("ExpectedTenure") - t, F.lit(0)).cast("int")),
        ("tenure_fraction_complete",
         F.least(t / at_least("ExpectedTenure", 1), F.lit(FRACTION_CAP))),
        ("high_monthly_charge", flag(m >= monthly_median)),
    ]


def serving_stage3(ratio_median: Column) -> list[tuple[str, Column]]:
    m = F.col("MonthlyCharges")
    return [
        ("remaining_value", F.greatest(F.col("CLV") - F.col("TotalCharges"), F.lit(0.0))),
        ("high_charge_to_clv_ratio", flag(m / at_least("CLV", 1.0) >= ratio_median)),
    ]
