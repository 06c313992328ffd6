"""Scoring and retention actions as Column expressions.

Everything is a per-row projection (no shuffle): the operating threshold and
the value-tier edges enter as literals fitted once elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.operators.reports import segment_label

# Fixed values that must equal the reference's for right results.
RISK_HIGH, RISK_MEDIUM = 0.70, 0.40
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.30, 0.20
CONFIDENCE_TEXT = {"High": "100% Certain", "Medium": "~80% Certain", "Low": "~60% Certain"}
VALUE_CAPTION = {"Low": "Below Average", "Medium": "Average", "High": "Above Average",
                 "Premium": "Top Tier"}
RECS_HIGH_RISK_HIGH_VALUE = [
    "Executive Intervention: personal call from account manager.",
    "Premium Offer: 20–30% discount or value-add bundle (security/backup).",
    "Contract Upgrade: propose annual term with incentive.",
    "Support Enhancement: free tech support for 3–6 months.",
]
RECS_HIGH_RISK = [
    "Winback Offer: time-limited discount (10–15%).",
    "Friction Removal: enable paperless & auto-pay with small credit.",
    "Service Fix: address frequent issues (tech support ticket).",
]
RECS_MEDIUM_RISK_HIGH_VALUE = [
    "Loyalty Perk: small monthly credit or feature add-on.",
    "Nudge: encourage paperless billing & auto-pay.",
    "Education: tips to use included services (security/backup).",
]
RECS_DEFAULT = [
    "Maintain Satisfaction: periodic check-ins (quarterly).",
    "Upsell Light: non-intrusive recommendations.",
    "No heavy discounts needed.",
]
PRIORITY_HIGH_HIGH = "HIGH PRIORITY: Contact within 24 hours"
PRIORITY_HIGH = "PRIORITY: Contact within 48–72 hours"
PRIORITY_MEDIUM_HIGH = "Monitor & nudge this month"
PRIORITY_DEFAULT = "No urgent action"
REC_PAPERLESS = "Activate Paperless Billing: small one-time bill credit."
REC_AUTOPAY = "Suggest Auto-Pay: reduce payment friction."


def decision(prob: Column, threshold: Column) -> Column:
    """1 when prob >= operating threshold."""
    return F.when(prob >= threshold, 1).otherwise(0)


def risk_bucket(prob: Column) -> Column:
    """I2."""
    return (F.when(prob >= RISK_HIGH, "High").when(prob >= RISK_MEDIUM, "Medium")
            .otherwise("Low"))


def confidence(prob: Column) -> Column:
    """I3 label, computed in doubles (p = 0.70 gives Low, p = 0.30 Medium)."""
    d = F.abs(prob - F.lit(0.5))
    return (F.when(d >= CONFIDENCE_HIGH, "High").when(d >= CONFIDENCE_MEDIUM, "Medium")
            .otherwise("Low"))


def _map(c: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr


def confidence_text(label: Column) -> Column:
    return _map(label, CONFIDENCE_TEXT)


def value_caption(segment: Column) -> Column:
    """I5."""
    return _map(segment, VALUE_CAPTION)


def _lits(texts):
    return F.array(*[F.lit(t) for t in texts])


def recommendations(risk: Column, value: Column, paperless: Column, payment: Column) -> Column:
    """I4 bullets: risk x value base list, then paperless and e-check extras."""
    high_value = value.isin("High", "Premium")
    base = (F.when((risk == "High") & high_value, _lits(RECS_HIGH_RISK_HIGH_VALUE))
            .when(risk == "High", _lits(RECS_HIGH_RISK))
            .when((risk == "Medium") & high_value, _lits(RECS_MEDIUM_RISK_HIGH_VALUE))
            .otherwise(_lits(RECS_DEFAULT)))
    extra_paper = F.when(F.coalesce(paperless == "No", F.lit(False)),
                         _lits([REC_PAPERLESS])).otherwise(F.array().cast("array<string>"))
    extra_pay = F.when(F.coalesce(payment, F.lit("")).startswith("Electronic"),
                       _lits([REC_AUTOPAY])).otherwise(F.array().cast("array<string>"))
    return F.concat(base, extra_paper, extra_pay)


def priority(risk: Column, value: Column) -> Column:
    high_value = value.isin("High", "Premium")
    return (F.when((risk == "High") & high_value, PRIORITY_HIGH_HIGH)
            .when(risk == "High", PRIORITY_HIGH)
            .when((risk == "Medium") & high_value, PRIORITY_MEDIUM_HIGH)
            .otherwise(PRIORITY_DEFAULT))


def form_paperless(c="PaperlessBilling") -> Column:
    """The form's payload value: 'Yes' when the toggle is on, else 'No'."""
    return F.when(F.coalesce(F.col(c) == "Yes", F.lit(False)), "Yes").otherwise("No")


def retention_list(scored: DataFrame, threshold: float | Column, edges, clv_col: str = "CLV") -> DataFrame:
    """I1 -> I2 -> E4 -> I3 -> I4 for every scored subscriber.  The threshold and the
    edges are numbers, or columns of ``scored``.

    ``scored`` holds serving features (``CLV``, ``PaperlessBilling``,
    ``PaymentMethod``) and ``prob``.
    """
    p = F.col("prob")
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    seg = segment_label(F.col(clv_col), edges)
    staged = scored.select(
        "customerID", p.alias("prob"), decision(p, threshold).alias("decision"),
        risk_bucket(p).alias("risk"), seg.alias("value_segment"),
        confidence(p).alias("confidence"), form_paperless().alias("_paper"),
        F.col("PaymentMethod").alias("_pay"))
    return staged.select(
        "customerID", "prob", "decision", "risk", "value_segment",
        value_caption(F.col("value_segment")).alias("value_caption"),
        "confidence", confidence_text(F.col("confidence")).alias("confidence_text"),
        F.array_join(recommendations(F.col("risk"), F.col("value_segment"), F.col("_paper"),
                                     F.col("_pay")), " | ").alias("recommendations"),
        priority(F.col("risk"), F.col("value_segment")).alias("priority"))


def risk_value_crosstab(retention: DataFrame) -> DataFrame:
    """Subscribers per (risk, value segment)."""
    return retention.groupBy("risk", "value_segment").agg(F.count(F.lit(1)).alias("customers"))
