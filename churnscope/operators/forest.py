"""Random forest with class weights balanced in every bootstrap.

A row's copies in a tree's bootstrap are Poisson(1), read off its draw for the
tree (``trees.draw_numbers``); they need no pass and no state.  One aggregate
counts every tree's bootstrap by class and gives its weights n / (2 n_class).
Trees grow in groups of ``GROUP``, a level of a group a pass, each node on its
own draw of about the square root of the design columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.operators.trees import (UNIT, WORD, Bins, Block, Rule, Tree, binned, block_of, drawn, fit_bins, grow, packed,
                                        unpacked)
from churnscope.session import release, stash

#: Trees that grow together.
GROUP = 50
FOREST_BINS = 32
#: Copies of a row: how many of these bounds its draw reaches (the distribution function of Poisson(1)).
COPIES = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * WORD) for k in range(8)]


@dataclass(frozen=True)
class ForestSettings:
    """The reference's model settings."""

    trees: int = 600
    max_depth: int = 10
    min_leaf: int = 20


@dataclass
class Forest:
    trees: list[Tree]
    bins: Bins
    weights: dict[int, tuple[float, float]]  # tree -> (weight of the rest, weight of a positive row)


def bootstrap_weights(rows: DataFrame, trees: int) -> DataFrame:
    """(tree, negatives, positives, weight_negative, weight_positive) of every tree's bootstrap of rows (y, u)."""
    t = F.col("tree").cast("bigint")
    a = ((F.lit(2654435769) * (2 * t + 1)) % (1 << 31)).bitwiseOR(F.lit(1).cast("bigint"))
    b = (F.lit(40503).cast("bigint") * t * t + 12345) % WORD
    draw = (F.col("u") * a + b) % WORD
    copies = sum((draw >= F.lit(bound)).cast("bigint") for bound in COPIES)
    each = rows.select("y", "u", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "tree", (F.col("y") == 1).alias("positive"), copies.alias("k"))
    sums = each.groupBy("tree").agg(F.sum(F.when(F.col("positive"), 0).otherwise(F.col("k"))).alias("negatives"),
                                    F.sum(F.when(F.col("positive"), F.col("k")).otherwise(0)).alias("positives"))
    return _balanced(sums)


def packed_bootstrap_weights(data: DataFrame, trees: int, b: Bins) -> DataFrame:
    """``bootstrap_weights`` of packed rows: a row a task and tree is added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, trees), np.int64)
        for batch in batches:
            for block in unpacked(batch, b):
                for t in range(trees):
                    k = copies_of(block.u, t)
                    sums[1, t] += (heavy := k[block.y == 1].sum())
                    sums[0, t] += k.sum() - heavy
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees, dtype=np.int32)), *map(pa.array, sums)],
                                         ["tree", "negatives", "positives"])

    parts = data.mapInArrow(run, "tree int, negatives long, positives long")
    sums = parts.groupBy("tree").agg(F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives"))
    return _balanced(sums.where("negatives + positives > 0"))


def _balanced(sums: DataFrame) -> DataFrame:
    total = (F.col("negatives") + F.col("positives")) / F.lit(2.0)
    return sums.select("tree", "negatives", "positives", *[
        (total / F.greatest(F.col(c), F.lit(1))).alias(f"weight_{c[:-1]}") for c in ("negatives", "positives")])


def copies_of(u: np.ndarray, tree: int) -> np.ndarray:
    return np.searchsorted(np.array(COPIES, np.uint64), drawn(u, tree), side="right")


def in_bootstrap(block: Block, tree: int) -> np.ndarray:
    """In a task: which rows are in a tree's bootstrap."""
    return drawn(block.u, tree) >= np.uint64(COPIES[0])


def weight_stats(weights: dict[int, tuple[float, float]]):
    """In a task: of rows in a tree's bootstrap the weight if positive and the weight, in units."""
    def stats(block: Block, tree: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, positive = copies_of(block.u[rows], tree), block.y[rows] == 1
        rest, heavy = weights[tree]
        h = np.rint(k * np.where(positive, heavy, rest) * UNIT).astype(np.int64)
        return np.where(positive, h, 0), h
    return stats


def fit_forest(train: DataFrame, settings: ForestSettings = ForestSettings(), bins: Bins | None = None,
               design_columns: int | None = None) -> Forest:
    """``design_columns`` is the number of numeric columns and levels (counted if not given)."""
    b = bins or fit_bins(train, FOREST_BINS)
    data = stash(packed(binned(train, b), b), "forest-rows")
    if design_columns is None:
        design_columns = len(b.numeric) + data.select(F.posexplode("levels").alias("column", "some")).select(
            "column", F.explode("some")).distinct().count()
    weights = {r.tree: (r.weight_negative, r.weight_positive)
               for r in packed_bootstrap_weights(data, settings.trees, b).collect()}
    rule = Rule(False, settings.max_depth, min_rows=settings.min_leaf,
                columns=max(1.0, math.sqrt(design_columns)) / design_columns, by_node=True)
    trees: dict[int, Tree] = {}
    for first in range(0, settings.trees, GROUP):
        group = [t for t in range(first, min(first + GROUP, settings.trees)) if t in weights]
        trees |= grow(data, b, group, in_bootstrap, weight_stats(weights), rule, lambda g, h: g / h if h else 0.0)
    release(data)
    return Forest([trees[t] for t in sorted(trees)], b, weights)


def score_forest(model: Forest, df: DataFrame, name: str = "rf") -> DataFrame:
    """(model, split, customerID, y, prob): the mean of the leaves' shares of positive weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = block_of(batch, model.bins)
            total = sum((block.values(t) for t in model.trees), np.zeros(block.n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * block.n, pa.string()), batch.column("split"), batch.column("customerID"),
                 batch.column("y"), pa.array(total / max(1, len(model.trees)))],
                ["model", "split", "customerID", "y", "prob"])

    rows = binned(df.withColumn("split", F.col("split").cast("string")), model.bins, keep=("split",))
    return rows.mapInArrow(run, "model string, split string, customerID string, y int, prob double")
