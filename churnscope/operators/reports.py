"""Aggregations and reports.

Every report is a single aggregation over the subscriber table (partial
aggregation before the shuffle; the grouped outputs have at most a few
dozen rows).  Dataset scalars (quartile edges, min/max) are computed once as
driver-side scalars and enter the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.functions.text import eq_lower, ne_lower
from churnscope.operators.stats import exact_quantiles

# Value tiers in ascending order.
TIER_LABELS = ["Low", "Medium", "High", "Premium"]
HIST_BINS = 30


def _check_edges(edges) -> None:
    if any(e is None for e in edges):
        raise ValueError("quartile edges undefined (no values)")
    if len(set(edges)) < len(edges):
        raise ValueError(f"quartile edges collapse: {edges}; four tiers cannot be formed")


def tier_ordinal(label: Column) -> Column:
    expr = None
    for i, name in enumerate(TIER_LABELS):
        expr = F.when(label == name, i) if expr is None else expr.when(label == name, i)
    return expr


def quartile_label(x: Column, edges) -> Column:
    """Right-closed tiers against ``[q1, q2, q3]`` (a value equal to q1 is Low)."""
    q1, q2, q3 = edges
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x <= q1, TIER_LABELS[0]).when(x <= q2, TIER_LABELS[1])
            .when(x <= q3, TIER_LABELS[2]).otherwise(TIER_LABELS[3]))


def segment_label(x: Column, edges) -> Column:
    """Left-closed tiers (a value equal to q1 is Medium)."""
    q1, q2, q3 = edges
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x < q1, TIER_LABELS[0]).when(x < q2, TIER_LABELS[1])
            .when(x < q3, TIER_LABELS[2]).otherwise(TIER_LABELS[3]))


def add_clv_quartile(df: DataFrame, clv_col: str = "CLV", edges=None) -> DataFrame:
    """Adds ``CLV_quartile``; raises when edges collapse."""
    if edges is None:
        edges = exact_quantiles(df, clv_col, [0.25, 0.5, 0.75])
    _check_edges(edges)
    return df.withColumn("CLV_quartile", quartile_label(F.col(clv_col), edges))


def clv_segment(df: DataFrame, edges, clv_col: str = "CLV", out: str = "clv_segment") -> DataFrame:
    """Left-closed value segment against (train) edges."""
    return df.withColumn(out, segment_label(F.col(clv_col), edges))


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(TIER_LABELS)],
                                 "CLV_quartile string, tier_ord int")


def churn_rate_by_quartile(df: DataFrame, y_col: str = "ChurnFlag",
                           keep_empty: bool = True) -> DataFrame:
    """size = non-null labels, churn_rate = mean, Low -> Premium order.

    Empty tiers appear with size 0 and a null rate when ``keep_empty``.
    """
    agg = (df.where(F.col("CLV_quartile").isNotNull())
           .groupBy("CLV_quartile")
           .agg(F.count(y_col).alias("size"), F.avg(F.col(y_col)).alias("churn_rate")))
    if keep_empty:
        tiers = tier_table(df.sparkSession)
        out = tiers.join(agg, "CLV_quartile", "left").select(
            "CLV_quartile", "tier_ord", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
            "churn_rate")
    else:
        out = agg.withColumn("tier_ord", tier_ordinal(F.col("CLV_quartile")))
    # four rows: one partition sorted locally, no range-partitioning sample job
    return out.coalesce(1).sortWithinPartitions("tier_ord")


def churn_by(df: DataFrame, key: Column | str, name: str, y_col: str = "ChurnFlag") -> DataFrame:
    """Churn rate per value of a column (null keys dropped as pandas does)."""
    k = F.col(key) if isinstance(key, str) else key
    return (df.where(k.isNotNull()).groupBy(k.alias(name))
            .agg(F.count(F.lit(1)).alias("customers"), F.avg(F.col(y_col)).alias("churn_rate")))


def autopay_key(c="PaymentMethod") -> Column:
    """``contains('automatic', case=False, na=False)``."""
    return F.coalesce(F.lower(F.col(c)).contains("automatic"), F.lit(False))


def churn_by_autopay(df: DataFrame, y_col: str = "ChurnFlag") -> DataFrame:
    return churn_by(df, autopay_key(), "autopay", y_col)


def support_mask(df_col_internet="InternetService", df_col_support="TechSupport", value="no"):
    return ne_lower(df_col_internet, "no") & eq_lower(df_col_support, value)


def churn_by_support(df: DataFrame, y_col: str = "ChurnFlag") -> DataFrame:
    """Among internet users, churn with and without tech support."""
    y = F.col(y_col)
    return df.agg(
        F.count_if(support_mask(value="no")).alias("customers_no_support"),
        F.avg(F.when(support_mask(value="no"), y)).alias("churn_no_support"),
        F.count_if(support_mask(value="yes")).alias("customers_support"),
        F.avg(F.when(support_mask(value="yes"), y)).alias("churn_support"))


def support_key() -> Column:
    """E8 as a key: ``no`` / ``yes`` among internet users, else null."""
    return F.when(support_mask(value="no"), "no").when(support_mask(value="yes"), "yes")


def report_keys() -> dict[str, Column]:
    """Level columns (text) of the reports E2 and E5-E8; ``CLV_quartile`` must have been added."""
    return {"quartile": F.col("CLV_quartile"), "contract": F.col("Contract"),
            "autopay": autopay_key().cast("string"), "payment": F.col("PaymentMethod"), "support": support_key()}


def churn_reports(df: DataFrame, keys: dict[str, Column] | None = None, y_col: str = "ChurnFlag") -> DataFrame:
    """E2 and E5-E8 by one plan: (report, level, customers, labelled, churn_rate).

    One scan; GROUPING SETS expand a row to a copy a report, which partial aggregation
    reduces to a row a level in each task before the one shuffle.  Rows whose
    level is null take no part in that report, ``labelled`` counts non-null targets.
    """
    keys = report_keys() if keys is None else keys
    rows = df.select(*[k.alias(name) for name, k in keys.items()], F.col(y_col).alias("_y"))
    of = F.coalesce(*[F.when(F.grouping(name) == 0, F.lit(name)) for name in keys])
    counted = rows.groupingSets([[F.col(name)] for name in keys], *[F.col(name) for name in keys]).agg(
        of.alias("report"), F.count(F.lit(1)).alias("customers"), F.count("_y").alias("labelled"),
        F.avg("_y").alias("churn_rate"))
    return counted.select("report", F.coalesce(*keys).alias("level"), "customers", "labelled",
                          "churn_rate").where(F.col("level").isNotNull())


def business_insights(df: DataFrame, edges=None, y_col: str = "ChurnFlag") -> DataFrame:
    """One record of all headline rates in a single aggregation pass."""
    if edges is None:
        edges = exact_quantiles(df, "CLV", [0.25, 0.5, 0.75])
    _check_edges(edges)
    y = F.col(y_col).cast("double")
    tier = quartile_label(F.col("CLV"), edges)
    c = F.col("Contract")

    def rate(cond: Column) -> Column:
        return F.avg(F.when(cond, y))

    return df.agg(
        rate(c == "Month-to-month").alias("contract_month_to_month"),
        rate(c == "One year").alias("contract_one_year"),
        rate(c == "Two year").alias("contract_two_year"),
        rate(autopay_key()).alias("autopay_auto"),
        rate(~autopay_key()).alias("autopay_manual"),
        rate(support_mask(value="no")).alias("tech_no_support"),
        rate(support_mask(value="yes")).alias("tech_support"),
        *[rate(tier == t).alias(f"clv_{t.lower()}") for t in TIER_LABELS])


def quartile_gap(summary: DataFrame) -> DataFrame:
    """Premium minus Low churn in percentage points, with direction."""
    low = F.max(F.when(F.col("CLV_quartile") == "Low", F.col("churn_rate")))
    prem = F.max(F.when(F.col("CLV_quartile") == "Premium", F.col("churn_rate")))
    agg = summary.agg((low * 100).alias("low_pct"), (prem * 100).alias("premium_pct"))
    diff = F.col("premium_pct") - F.col("low_pct")
    return agg.select("low_pct", "premium_pct", diff.alias("diff_pp"),
                      F.abs(diff).alias("abs_diff_pp"),
                      F.when(diff > 0, "higher").otherwise("lower").alias("direction"))


def worst_segment(summary: DataFrame) -> DataFrame:
    """Highest churn tier, the first (lowest tier) on ties."""
    return (summary.where(F.col("churn_rate").isNotNull())
            .orderBy(F.desc("churn_rate"), "tier_ord").limit(1)
            .select("CLV_quartile", "churn_rate"))


def top_segments(summary: DataFrame, k: int = 2) -> DataFrame:
    """The k tiers with most churn (tier order breaks ties)."""
    return (summary.where(F.col("churn_rate").isNotNull())
            .orderBy(F.desc("churn_rate"), "tier_ord").limit(k)
            .select("CLV_quartile", "tier_ord", "churn_rate"))


def segment_share(summary: DataFrame) -> DataFrame:
    """Share of customers per tier (summary has four rows)."""
    total = F.sum("size").over(Window.partitionBy())
    return summary.select(
        "CLV_quartile", "tier_ord", "size",
        F.when(total > 0, F.col("size") / total * 100).otherwise(F.lit(0.0)).alias("share_pct"),
        (F.col("churn_rate") * 100).alias("churn_pct"))


def describe_column(df: DataFrame, column: str = "CLV", quartiles=None) -> DataFrame:
    """Count, mean, std (ddof 1), min, quartiles (fitted here unless given), max."""
    q = exact_quantiles(df, column, [0.25, 0.5, 0.75]) if quartiles is None else quartiles
    x = F.col(column)
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                  F.max(x).alias("max")).select(
        "count", "mean", "std", "min",
        F.lit(q[0]).cast("double").alias("p25"), F.lit(q[1]).cast("double").alias("p50"),
        F.lit(q[2]).cast("double").alias("p75"), "max")


def histogram(df: DataFrame, column: str = "CLV", bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over [min, max]; the max lands in the last bin.

    min/max come from one aggregate; each row's bin is a scalar expression,
    the count a grouped aggregate, and empty bins are filled from a
    ``range(bins)`` table.
    """
    x = F.col(column)
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, customers bigint")
    width = (hi - lo) / bins
    if width == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((x - F.lit(lo)) * bins / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / bins).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(hi - lo) / bins).alias("bin_hi"),
                    F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers")))


def skew_report(both: DataFrame, columns) -> DataFrame:
    """Per feature, subscribers whose training and serving values differ.

    ``both`` holds the two definitions of each row side by side
    (``features.paired_features``), so they are compared null-safely in one
    aggregate, whatever the ids are.
    """
    differ = [~F.col(f"t_{c}").cast("double").eqNullSafe(F.col(c).cast("double")) if _numeric(both, c)
              else ~F.col(f"t_{c}").cast("string").eqNullSafe(F.col(c).cast("string")) for c in columns]
    counts = both.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(d).alias(f"d_{c}") for c, d in zip(columns, differ)])
    stack = ", ".join(f"'{c}', `d_{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {stack}) as (feature, rows_differ)",
                             "_rows as rows_compared")


def _numeric(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "short")
