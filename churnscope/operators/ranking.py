"""Distributed running sums over a sorted numeric column.

A window ``partitionBy(keys).orderBy(x)`` puts a whole key group in one task;
with (model, split) keys and one row per distinct score that group grows
with the data.  ``running_sums`` splits the order column of each key into
range buckets, runs the window per ``(keys, bucket)`` and adds each bucket's
offset, i.e. the totals of all earlier buckets.

The cut points are taken per key, so a key whose values lie close together is
split like any other, and are written to the shared folder, so a recomputed
task sees the same ones.  A row finds its bucket by looking through every
``step``-th cut and then through the cuts between two of them, about twice the
square root of their number, in an expression of constant size.  The number
of buckets follows the data (``ROWS_PER_BUCKET``) and changes no result.  The tables of cuts (one row per key) and of offsets
(keys x buckets rows) are joined without hints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.session import stash

ROWS_PER_BUCKET = 500_000


def range_cuts(df: DataFrame, keys: list[str], column: str, buckets: int) -> DataFrame:
    """(keys..., cuts): at most ``buckets - 1`` ascending cut points of each key."""
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = F.percentile_approx(F.col(column).cast("double"), probs, max(10000, 4 * buckets))
    some = F.array_sort(F.array_distinct("cuts")) if buckets > 1 else F.array().cast("array<double>")
    return stash(df.groupBy(*keys).agg(cuts.alias("cuts")).select(*keys, some.alias("cuts")), "range-cuts")


def bucket_of(x: Column, cuts: Column, step: int) -> Column:
    """Number of cut points <= x, by a two-level search."""
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts), F.lit(1)), F.lit(step)),
                        lambda i: F.get(cuts, i - 1))
    before = F.size(F.filter(heads, lambda c: c <= x))
    begin = F.greatest((before - 1) * step, F.lit(0))
    inside = F.size(F.filter(F.slice(cuts, begin + 1, F.lit(step)), lambda c: c <= x))
    return (begin + inside).cast("int")


def running_sums(df: DataFrame, keys: list[str], order_col: str, sum_cols: list[str],
                 descending: bool = False, buckets: int | None = None,
                 prefix: str = "cum_", following: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` within ``keys``.

    ``order_col`` must be unique within a key group (aggregate to distinct
    values first).  Adds ``prefix + c`` for each summed column and, for each
    column in ``following``, ``next_`` + its name: its value in the row after.
    """
    if buckets is None:
        buckets = max(1, math.ceil(df.count() / ROWS_PER_BUCKET))
    step = max(1, math.isqrt(buckets))
    cuts = range_cuts(df, keys, order_col, buckets)
    b = bucket_of(F.col(order_col).cast("double"), F.col("cuts"), step)
    staged = df.join(cuts, keys).withColumn("_bkt", -b if descending else b).drop("cuts")
    order = F.desc(order_col) if descending else F.asc(order_col)
    inside = Window.partitionBy(*keys, "_bkt").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.select("*", *[F.sum(c).over(upto).alias(f"_loc_{c}") for c in sum_cols],
                          *[F.lead(c).over(inside).alias(f"_next_{c}") for c in following])
    first = F.min_by if not descending else F.max_by
    totals = staged.groupBy(*keys, "_bkt").agg(
        *[F.sum(c).alias(f"_tot_{c}") for c in sum_cols],
        *[first(c, order_col).alias(f"_head_{c}") for c in following])
    ordered = Window.partitionBy(*keys).orderBy("_bkt")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bkt", *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
        *[F.lead(f"_head_{c}").over(ordered).alias(f"_head_{c}") for c in following])
    joined = local.join(offsets, [*keys, "_bkt"])
    return joined.select(
        *df.columns, *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(prefix + c) for c in sum_cols],
        *[F.coalesce(f"_next_{c}", f"_head_{c}").alias(f"next_{c}") for c in following])
