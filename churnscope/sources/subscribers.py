"""The raw subscriber table.

``RAW_SCHEMA`` is the 21-column subscriber layout (customerID + 20 attributes).
``read_raw_csv`` scans such a CSV with that explicit schema (no inference
pass).  ``derive_subscribers`` builds the same layout from the given
``customer`` and ``orders`` tables by the rules of FIXTURES.md, so every job
downstream reads data whose size grows with the given tables.

Plan: orders are reduced to one row per customer with a partial (map-side)
hash aggregate before the shuffle, so a customer holding a third of all
orders costs one row per map task; the result is joined to ``customer`` on
the customer key (sort-merge or shuffled-hash; AQE picks broadcast only when
the measured side is small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.sources.tables import read_table

RAW_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# Fixed values of the fixture rules (FIXTURES.md section 1).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MONTHLY_SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY"]
LAST_MONTH = 2001 * 12 + 8


MALFORMED = "_malformed"


def read_raw_csv(spark: SparkSession, path: str, keep_malformed: bool = False) -> DataFrame:
    """A1: scan a subscriber CSV with a header and the explicit schema.

    Ids are text.  Rows that do not fit the schema have nulls where they do
    not; ``keep_malformed`` adds a column with the text of such a row, for
    ``count_malformed``.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(MALFORMED, T.StringType())])
    return (spark.read.schema(schema if keep_malformed else RAW_SCHEMA).option("header", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).csv(path))


def count_malformed(df: DataFrame) -> DataFrame:
    """Rows, rows with any value and malformed rows of a CSV read with ``keep_malformed``.

    Every column is referenced: a column that is pruned is not parsed either.
    """
    anything = F.coalesce(*[F.col(c).cast("string") for c in RAW_COLUMNS])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(anything).alias("n_with_values"),
                  F.count(MALFORMED).alias("n_malformed"))


def require_columns(df: DataFrame, needed, stage: str) -> DataFrame:
    """Fail before planning when required columns are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{stage}: missing columns {missing}")
    return df


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def order_profile(orders: DataFrame) -> DataFrame:
    """One row per customer: last fulfilled month and order counts."""
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    month_no = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    aggs = [F.max(F.when(status == "F", month_no)).alias("last_f")]
    aggs += [F.count_if(prio == p).alias(f"n{i + 1}") for i, p in enumerate(PRIORITIES)]
    aggs += [F.count_if(status == "P").alias("n_p"), F.count_if(status == "O").alias("n_o")]
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(*aggs)


def derive_subscribers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    prof = order_profile(orders.select("o_custkey", "o_orderstatus", "o_orderdate",
                                       "o_orderpriority"))
    c = customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"),
                        "c_acctbal", "c_mktsegment")
    j = c.join(prof, "k", "left")
    k, nk = F.col("k"), F.col("nk")
    cnt = {name: F.coalesce(F.col(name), F.lit(0))
           for name in ["n1", "n2", "n3", "n4", "n5", "n_p", "n_o"]}
    tenure = (F.when(k % 401 == 11, F.lit(-1))  # a broken record: its total can only be imputed
              .when(F.col("last_f").isNull(), F.lit(0))
              .otherwise(F.least(F.lit(72), F.lit(LAST_MONTH) - F.col("last_f")))
              .cast("int"))
    no_net = (nk % 5) == 0

    def addon(n: Column) -> Column:
        return F.when(no_net, "No internet service").when(n >= 2, "Yes").otherwise("No")

    monthly = (F.lit(20) + F.floor(F.abs(F.col("c_acctbal"))) % 100
               + F.lit(0.25) * (k % 4)).cast("double")
    monthly_segment = F.col("c_mktsegment").isin(MONTHLY_SEGMENTS)
    contract = (F.when(k % 211 == 7, "Weekly")
                .when(k % 101 == 3, "  month-to-MONTH ")
                .when(monthly_segment, "Month-to-month")
                .when(F.col("c_mktsegment") == "HOUSEHOLD", "One year")
                .when(F.col("c_mktsegment") == "FURNITURE", "Two year"))
    points = (3 * _flag(monthly_segment) + 2 * _flag(nk % 5 >= 3)
              + _flag((cnt["n4"] < 2) & ~no_net) + 2 * _flag(F.col("tenure") <= 6)
              + _flag(k % 12 < 3) - _flag(k % 12 >= 6) + (k * 31) % 7)
    total_text = F.when((F.col("tenure") <= 0) | (k % 89 == 1), F.lit(" ")).otherwise(
        (F.col("tenure") * F.col("MonthlyCharges") + F.lit(0.25) * (k % 40)).cast("string"))

    base = j.select(
        k, nk, "c_mktsegment", tenure.alias("tenure"), monthly.alias("MonthlyCharges"),
        *[cnt[n].alias(n) for n in cnt])
    out = base.select(
        k.cast("string").alias("customerID"),
        F.when(k % 4 < 2, "Female").otherwise("Male").alias("gender"),
        _flag(k % 6 == 0).cast("int").alias("SeniorCitizen"),
        F.when(k % 2 == 0, "Yes").otherwise("No").alias("Partner"),
        F.when(k % 10 < 3, "Yes").otherwise("No").alias("Dependents"),
        "tenure",
        F.when(k % 11 == 0, "No").otherwise("Yes").alias("PhoneService"),
        F.when(k % 11 == 0, "No phone service").when(cnt["n_o"] >= 4, "Yes")
        .otherwise("No").alias("MultipleLines"),
        F.when(k % 307 == 5, F.lit(None).cast("string")).when(no_net, "No")
        .when(nk % 5 < 3, "DSL").otherwise("Fiber optic").alias("InternetService"),
        addon(cnt["n1"]).alias("OnlineSecurity"),
        addon(cnt["n2"]).alias("OnlineBackup"),
        addon(cnt["n3"]).alias("DeviceProtection"),
        addon(cnt["n4"]).alias("TechSupport"),
        addon(cnt["n5"]).alias("StreamingTV"),
        F.when(no_net, "No internet service").when(cnt["n_p"] >= 4, "Yes")
        .otherwise("No").alias("StreamingMovies"),
        contract.alias("Contract"),
        F.when(k % 5 < 3, "Yes").otherwise("No").alias("PaperlessBilling"),
        F.when(k % 151 == 9, F.lit(None).cast("string"))
        .when(k % 12 < 3, "Electronic check").when(k % 12 < 6, "Mailed check")
        .when(k % 12 < 9, "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)").alias("PaymentMethod"),
        "MonthlyCharges",
        total_text.alias("TotalCharges"),
        F.when(points >= 9, "Yes").otherwise("No").alias("Churn"),
    )
    return out


def load_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    return derive_subscribers(customer, orders)
