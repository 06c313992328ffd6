"""Gradient boosting with second-order gains, early stopping by AUC, and Shapley values.

``fit_boosting`` grows one tree a round from gradients and hessians of the logistic
loss (``trees.grow``).  Margins live in the training table; every ``REFRESH`` rounds it
is written anew, in between tasks add the trees since.  Validation rows are scored at
every round of a block of rounds at once, and one AUC plan keyed by round reads them.
The prefix of rounds with the best AUC is kept once ``patience`` rounds bring no gain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.features import TARGET
from churnscope.operators.evaluate import roc_auc, score_counts
from churnscope.operators.trees import (UNIT, WORD, Bins, Block, Rule, Split, Tree, binned, block_of, drawn, fit_bins,
                                       grow, packed, unpacked)
from churnscope.session import release, stash

#: Rounds between two writings of the margins, and between two looks at the validation rows.
REFRESH = 10
#: Rows of the sample that global importance is taken over (a fixed value of the reference).
SHAPLEY_ROWS = 600


@dataclass(frozen=True)
class Settings:
    """The reference's model settings."""

    rounds: int = 800
    learning_rate: float = 0.05
    max_depth: int = 5
    min_child_weight: float = 4.0
    subsample: float = 0.8
    colsample: float = 0.8
    reg_lambda: float = 2.0
    gamma: float = 0.0
    patience: int = 50

    def rule(self) -> Rule:
        return Rule(True, self.max_depth, reg=self.reg_lambda, min_h=self.min_child_weight,
                    gamma=max(self.gamma, 1e-6), columns=self.colsample)

    def leaf(self, g: int, h: int) -> float:
        return -self.learning_rate * (g / UNIT) / (h / UNIT + self.reg_lambda)


@dataclass
class Boosted:
    """A fitted model: its trees in order (the best prefix), bins, and the AUC of every round tried."""

    trees: list[Tree]
    bins: Bins
    settings: Settings
    weight: float        # of a positive row
    auc: list[float | None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def subsample(settings: Settings):
    """In a task: the rows drawn for a tree."""
    def taken(block: Block, tree: int) -> np.ndarray:
        return drawn(block.u, tree) < np.uint64(int(settings.subsample * WORD))
    return taken


def gradient_stats(since: list[Tree], weight: float):
    """In a task: gradients and hessians of rows at their margins, in units."""
    def stats(block: Block, tree: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid((block.margin + sum((block.values(t) for t in since), np.zeros(block.n)))[rows])
        positive = block.y[rows] == 1
        w = np.where(positive, weight, 1.0)
        g = np.rint(w * (p - positive) * UNIT).astype(np.int64)
        h = np.rint(w * p * (1.0 - p) * UNIT).astype(np.int64)
        return g, h
    return stats


def _moved(data: DataFrame, b: Bins, trees: list[Tree]) -> DataFrame:
    """The packed rows with the trees' values added to their margins, written."""
    schema = data.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [(block.margin + sum((block.values(t) for t in trees), np.zeros(block.n))).tobytes()
                       for block in unpacked(batch, b)]
            at = batch.schema.get_field_index("margin")
            yield pa.RecordBatch.from_arrays([pa.array(margins, pa.binary()) if i == at else c
                                              for i, c in enumerate(batch.columns)], batch.schema.names)

    return stash(data.mapInArrow(run, schema), "boosting-rows")


def staged_margins(data: DataFrame, b: Bins, trees: list[Tree], first: int) -> DataFrame:
    """(round, y, prob): the rows' margins, before the logistic function, after each of these rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (block for batch in batches for block in unpacked(batch, b)):
            margin, y = block.margin, pa.array((block.y == 1).astype(np.int32), mask=np.isnan(block.y.astype(float)))
            for i, tree in enumerate(trees):
                margin = margin + block.values(tree)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(block.n, first + i, np.int32)),
                                                  y, pa.array(margin)], ["round", "y", "prob"])

    return data.mapInArrow(run, "round int, y int, prob double")


def auc_by_round(staged: DataFrame) -> DataFrame:
    """(round, auc) of (round, y, prob) in one plan."""
    return roc_auc(score_counts(staged, ["round"], materialize=True), ["round"])


def best_round(auc: DataFrame, patience: int = 50) -> DataFrame:
    """F8: (round, auc, best, used) of rounds 1, 2, ... in order.

    Training ends with the first round that lies ``patience`` rounds behind the best one so far; ``best`` marks the
    kept round (the first of the highest AUC up to there) and ``used`` the rounds looked at.  The rows are as
    many as the rounds."""
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    score = F.coalesce("auc", F.lit(-1.0))
    lead = F.max(F.struct(score.alias("s"), (-F.col("round")).alias("r"))).over(upto)
    rows = auc.select("round", "auc", (-lead["r"]).alias("lead"))
    ended = F.min(F.when(F.col("round") - F.col("lead") >= patience, F.col("round"))).over(Window.partitionBy())
    rows = rows.select("*", (F.col("round") <= F.coalesce(ended, F.col("round"))).alias("used"))
    kept = F.max(F.when(F.col("used"), F.struct("round", "lead"))).over(Window.partitionBy())["lead"]
    return rows.select("round", "auc", (F.col("round") == kept).alias("best"), "used")


def class_weight(train: DataFrame, target: str = TARGET) -> float:
    row = train.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) != 1).alias("n")).first()
    return row["n"] / max(1, row["p"])


def fit_boosting(train: DataFrame, val: DataFrame | None = None, settings: Settings = Settings(),
                 bins: Bins | None = None) -> Boosted:
    """F7 with F8: trees on ``train``, stopped by the AUC of ``val`` (without it, all rounds are kept)."""
    b = bins or fit_bins(train)
    weight = class_weight(train)
    data = stash(packed(binned(train, b), b), "boosting-rows")
    held = stash(packed(binned(val, b), b), "boosting-rows") if val is not None else None
    model = Boosted([], b, settings, weight, [])
    since: list[Tree] = []
    while len(model.trees) < settings.rounds:
        number = len(model.trees)
        tree = grow(data, b, [number], subsample(settings), gradient_stats(since, weight), settings.rule(),
                    settings.leaf)[number]
        model.trees.append(tree)
        since.append(tree)
        if len(since) < REFRESH and len(model.trees) < settings.rounds:
            continue
        if held is not None:
            first = len(model.trees) - len(since) + 1
            found = {r["round"]: r["auc"] for r in auc_by_round(staged_margins(held, b, since, first)).collect()}
            model.auc += [found.get(first + i) for i in range(len(since))]
            if _ended(model.auc, settings.patience):
                break
        data, held = _advance(data, b, since), None if held is None else _advance(held, b, since)
        since = []
    release(data, *([held] if held is not None else []))
    if held is not None:
        seen = [(i + 1, a) for i, a in enumerate(model.auc)]
        rows = best_round(train.sparkSession.createDataFrame(seen, "round int, auc double"), settings.patience)
        model.trees = model.trees[:rows.where("best").first()["round"]]
    return model


def _ended(auc: list[float | None], patience: int) -> bool:
    """Whether a round lies ``patience`` behind the best before it."""
    lead, at = -2.0, 0
    for i, a in enumerate(auc):
        if (a if a is not None else -1.0) > lead:
            lead, at = a if a is not None else -1.0, i
        elif i - at >= patience:
            return True
    return False


def _advance(data: DataFrame, b: Bins, trees: list[Tree]) -> DataFrame:
    moved = _moved(data, b, trees)
    release(data)
    return moved


def score_boosting(model: Boosted, df: DataFrame, name: str = "xgb") -> DataFrame:
    """(model, split, customerID, y, prob) of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = block_of(batch, model.bins)
            margin = sum((block.values(t) for t in model.trees), np.zeros(block.n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * block.n, pa.string()), batch.column("split"), batch.column("customerID"),
                 batch.column("y"), pa.array(_sigmoid(margin))], ["model", "split", "customerID", "y", "prob"])

    rows = binned(df.withColumn("split", F.col("split").cast("string")), model.bins, keep=("split",))
    return rows.mapInArrow(run, "model string, split string, customerID string, y int, prob double")


def training_loss(model: Boosted, train: DataFrame, rounds: int) -> DataFrame:
    """(round, loss): weighted logistic loss of the training rows after each of the first rounds."""
    staged = staged_margins(packed(binned(train, model.bins), model.bins), model.bins, model.trees[:rounds], 1)
    m, positive = F.col("prob"), F.col("y") == 1
    loss = F.when(positive, F.log1p(F.exp(-m)) * F.lit(model.weight)).otherwise(F.log1p(F.exp(m)))
    return staged.groupBy("round").agg(F.avg(loss).alias("loss"))


# ---- Shapley values of trees ------------------------------------------------------

@dataclass(frozen=True)
class Path:
    """A leaf: its value, and for each design column on the way the splits with the side taken, and the share
    of the cover that goes the leaf's way at them."""

    value: float
    features: list[str]
    turns: list[list[tuple[Split, bool]]]
    shares: list[float]


def paths_of(tree: Tree) -> list[Path]:
    out, stack = [], [(1, {}, {})]
    while stack:
        node, turns, shares = stack.pop()
        split = tree.splits.get(node)
        if split is None:
            out.append(Path(tree.values[node], list(turns), list(turns.values()), [shares[f] for f in turns]))
            continue
        for child, left in ((2 * node, True), (2 * node + 1, False)):
            share = tree.sums[child][1] / tree.sums[node][1]
            f = split.feature
            stack.append((child, {**turns, f: [*turns.get(f, []), (split, left)]},
                          {**shares, f: shares.get(f, 1.0) * share}))
    return out


def expected_margin(trees: list[Tree]) -> float:
    """The margin when no column is known: leaf values weighted by cover."""
    return sum(p.value * math.prod(p.shares) for t in trees for p in paths_of(t))


def shapley_block(block: Block, paths: list[Path], names: dict[str, int]) -> np.ndarray:
    """Contributions (rows x design columns).  On a path of d columns, a column's part is the leaf's value times
    (follows - share), times the chance, over the orders of the d columns, that the others before it follow and
    those after it go the leaf's way by cover; these chances are the coefficients of a product of d - 1 terms."""
    out = np.zeros((block.n, len(names)))
    known: dict[Split, np.ndarray] = {}
    for path in paths:
        d = len(path.features)
        follow = []
        for turns in path.turns:
            ok = np.ones(block.n, bool)
            for split, left in turns:
                if split not in known:
                    known[split] = block.left(split)
                ok &= known[split] == left
            follow.append(ok.astype(float))
        orders = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        for i, feature in enumerate(path.features):
            terms = [np.ones(block.n)]
            for j in range(d):
                if j != i:
                    up = [np.zeros(block.n), *(c * follow[j] for c in terms)]
                    terms = [a + b for a, b in zip([*(c * path.shares[j] for c in terms), 0.0], up)]
            chance = sum(w * c for w, c in zip(orders, terms))
            out[:, names[feature]] += path.value * (follow[i] - path.shares[i]) * chance
    return out


def contributions(model: Boosted, df: DataFrame) -> DataFrame:
    """H2: (customerID, margin, expected, feature, contribution) of the rows, for the model's design columns."""
    paths = [p for t in model.trees for p in paths_of(t)]
    features = sorted({f for p in paths for f in p.features})
    names, expected = {f: i for i, f in enumerate(features)}, expected_margin(model.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = block_of(batch, model.bins)
            phi = shapley_block(block, paths, names)
            margin = sum((block.values(t) for t in model.trees), np.zeros(block.n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * len(names)),
                                             pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("customerID"), pa.array(margin), lists],
                                             ["customerID", "margin", "phi"])

    rows = binned(df, model.bins).mapInArrow(run, "customerID string, margin double, phi array<double>")
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("phi").alias("contribution"))
    return rows.select("customerID", "margin", F.lit(expected).alias("expected"), F.explode(pairs).alias("p")).select(
        "customerID", "margin", "expected", F.col("p.feature"), F.col("p.contribution"))


def shapley_importance(found: DataFrame) -> DataFrame:
    """(feature, coef): the mean absolute contribution of each design column."""
    return found.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("coef"))
