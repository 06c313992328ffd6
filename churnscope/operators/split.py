"""Splits and sampling.

Row order comes from an md5 hash of the row id, which Spark and plain SQL
compute identically, so a split is reproducible anywhere and stable per
subscriber.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the split: hash range and 60/20/20 shares.
HASH_MODULUS = 2147483647
SPLIT_WEIGHTS = (3, 1, 1)  # train, val, test out of 5
SPLIT_NAMES = ("train", "val", "test")


def row_hash(id_col="customerID", salt: int = 42) -> Column:
    """Deterministic pseudo-random order key in [0, 2^31 - 1) of a text id."""
    k = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    digest = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(k, F.lit("")))), 1, 12)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(HASH_MODULUS))


def stratified_split(df: DataFrame, label: str = "ChurnFlag", id_col: str = "customerID",
                     salt: int = 42, buckets: int | None = None) -> DataFrame:
    """60/20/20 per class, adds ``split``.

    Rows of one class are ranked by the hash; rank r of n goes to train when
    5r < 3n, to val when 5r < 4n, else to test.  The rank is computed in
    ranges of the hash: ``row_number`` inside (label, range) plus the rows of
    the class in earlier ranges, from a table of labels x ranges rows.  The
    number of ranges (by default that of shuffle partitions) only spreads the
    work; the split is the same for every number.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    keyed = df.withColumn("_h", row_hash(id_col, salt)).withColumn(
        "_b", F.floor(F.col("_h") * F.lit(buckets).cast("bigint") / F.lit(HASH_MODULUS)).cast("int"))
    counts = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(label).alias("_l"), F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(label)).alias("_n"))
    inside = Window.partitionBy(label, "_b").orderBy("_h", id_col)
    ranked = (keyed.withColumn("_r", F.row_number().over(inside) - 1)
              .join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_ob")))
              .withColumn("_r", F.col("_r") + F.col("_before")))
    tr, va, _ = SPLIT_WEIGHTS
    total = sum(SPLIT_WEIGHTS)
    split = (F.when(F.col("_r") * total < F.col("_n") * tr, SPLIT_NAMES[0])
             .when(F.col("_r") * total < F.col("_n") * (tr + va), SPLIT_NAMES[1])
             .otherwise(SPLIT_NAMES[2]))
    return ranked.withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def hash_split(df: DataFrame, id_col: str = "customerID", salt: int = 42) -> DataFrame:
    """D1 Bernoulli variant: no shuffle at all, shares exact only in expectation."""
    u = row_hash(id_col, salt)
    tr, va, _ = SPLIT_WEIGHTS
    total = sum(SPLIT_WEIGHTS)
    # thresholds as bigint literals: the modulus times a weight exceeds int range
    split = (F.when(u * total < F.lit(HASH_MODULUS * tr), SPLIT_NAMES[0])
             .when(u * total < F.lit(HASH_MODULUS * (tr + va)), SPLIT_NAMES[1])
             .otherwise(SPLIT_NAMES[2]))
    return df.withColumn("split", split)


def split_shares(df: DataFrame, label: str = "ChurnFlag") -> DataFrame:
    """Rows and positives per split, with shares of the total."""
    agg = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                  F.sum(F.col(label)).cast("bigint").alias("positives"))
    total = Window.partitionBy()
    return agg.select(
        "split", "rows", "positives",
        (F.col("rows") / F.sum("rows").over(total)).alias("row_share"),
        (F.col("positives") / F.col("rows")).alias("positive_rate"))


def bounded_sample(df: DataFrame, n: int, id_col: str = "customerID", salt: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by hash order (TakeOrdered: top-n per task)."""
    return (df.withColumn("_h", row_hash(id_col, salt))
            .orderBy("_h", id_col).limit(n).drop("_h"))


def class_counts(df: DataFrame, label: str = "ChurnFlag") -> DataFrame:
    """D3: negatives, positives and ``scale_pos_weight = neg / max(1, pos)``."""
    agg = df.agg(F.count_if(F.col(label) == 0).alias("negatives"),
                 F.count_if(F.col(label) == 1).alias("positives"))
    return agg.withColumn(
        "scale_pos_weight",
        F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)).cast("double"))


def balanced_weights(df: DataFrame, label: str = "ChurnFlag") -> DataFrame:
    """Per class ``n / (2 * n_class)`` (the two-class 'balanced' rule)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = Window.partitionBy()
    n_classes = F.count(F.lit(1)).over(total)
    return counts.select(
        label, "n_class",
        (F.sum("n_class").over(total) / (n_classes * F.col("n_class"))).alias("class_weight"))
