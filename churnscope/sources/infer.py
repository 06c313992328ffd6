"""A1: column types of a CSV inferred from every row.

Each value belongs to the narrowest kind that it fits: missing, boolean, whole
number, number, text.  A column's type is the join of the kinds of its values:

    missing only -> double        booleans -> boolean
    whole numbers -> bigint       numbers, whole or not -> double
    booleans and numbers, or any text -> string

The counts of kinds are one aggregate over all rows and columns, with partial counts in
each task; one row a column reaches the driver.  No sample decides a type.  A column of whole
numbers with missing values stays bigint, since Spark's integers can be null.
A file without rows gives double for every column of its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.text import NUMERIC_TEXT, WHITESPACE

# Texts that read as missing, as booleans and as numbers beyond the digits.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]
WHOLE_TEXT = r"^\s*[+-]?[0-9]+\s*$"
INFINITE = ["inf", "-inf", "+inf", "infinity", "-infinity", "+infinity"]

KINDS = ("missing", "boolean", "whole", "number", "text")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column of a CSV with a header, as text and untrimmed."""
    return spark.read.option("header", True).csv(path)


def _number(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(WHITESPACE))
    return F.when(text.rlike(NUMERIC_TEXT) | F.lower(trimmed).isin(INFINITE), trimmed.try_cast("double"))


def _whole(text: Column) -> Column:
    """The whole number in a text; null where it is none or beyond 64 bits."""
    return F.when(text.rlike(WHOLE_TEXT), F.trim(text, F.lit(WHITESPACE)).try_cast("bigint"))


def kind(text: Column) -> Column:
    """Index in ``KINDS`` of the narrowest kind of a value."""
    return (F.when(text.isNull() | text.isin(MISSING), 0).when(text.isin(BOOLEANS), 1)
            .when(_whole(text).isNotNull(), 2).when(_number(text).isNotNull(), 3).otherwise(4))


def infer_types(rows: DataFrame) -> DataFrame:
    """(place, column_name, n_missing, n_boolean, n_whole, n_number, n_text, type) for each text column."""
    # columns are renamed by place: names may hold dots, quotes or differ in case alone
    kinds = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).select(
        *[kind(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(rows.columns))])
    counts = kinds.agg(*[F.struct(*[F.count_if(F.col(f"c{i}") == k).alias(f"n_{name}")
                                    for k, name in enumerate(KINDS)]).alias(f"c{i}")
                         for i in range(len(rows.columns))])
    entries = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("column_name"), F.col(f"c{i}").alias("n"))
               for i, name in enumerate(rows.columns)]
    numbers = (F.col("n_whole") + F.col("n_number")) > 0
    found = (F.when((F.col("n_text") > 0) | (numbers & (F.col("n_boolean") > 0)), "string")
             .when(F.col("n_boolean") > 0, "boolean").when(F.col("n_number") > 0, "double")
             .when(F.col("n_whole") > 0, "bigint").otherwise("double"))
    return counts.select(F.explode(F.array(*entries)).alias("e")).select(
        "e.place", "e.column_name", "e.n.*").withColumn("type", found)


def typed(rows: DataFrame, types: list[str]) -> DataFrame:
    """Text columns as columns of ``types``; missing texts become null."""
    def value(i: int, to: str) -> Column:
        text = F.col(f"c{i}")
        read = {"boolean": F.lower(text) == "true", "bigint": _whole(text), "double": _number(text)}.get(to, text)
        return F.when(~text.isin(MISSING), read)
    return rows.toDF(*[f"c{i}" for i in range(len(types))]).select(
        *[value(i, to).alias(name) for i, (name, to) in enumerate(zip(rows.columns, types))])


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, read with the types that fit all of its rows: one pass for the types,
    then the scan itself, lazily."""
    rows = read_text_csv(spark, path)
    return typed(rows, [r["type"] for r in infer_types(rows).orderBy("place").collect()])
