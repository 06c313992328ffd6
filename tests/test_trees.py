"""Histogram trees, boosting, the balanced forest and Shapley values against plain Python versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.operators import boosting as bo
from churnscope.operators import forest as fo
from churnscope.operators import trees as ht

NUMERIC, CATEGORICAL = ["a", "b", "c"], ["k", "m"]


def _rows(n=220, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = draw.choice([None, 0.0, 1.0, 2.5, 7.0]), draw.random()
        k, m = draw.choice(["x", "y", "z", None]), draw.choice(["u", "v"])
        y = int(draw.random() < 0.15 + 0.5 * (k == "x") + 0.25 * (a is None) - 0.1 * (b > 0.5))
        rows.append((str(i), "train" if i % 4 else "val", y, a, b, 5.0, k, m))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), "customerID string, split string, ChurnFlag int, a double, b double, "
                                          "c double, k string, m string")


@pytest.fixture(scope="module")
def bins(table):
    return ht.fit_bins(table, 16, NUMERIC, CATEGORICAL)


@pytest.fixture(scope="module")
def plain(table, bins):
    """The binned rows as Python objects."""
    return ht.binned(table.where("split = 'train'"), bins).collect()


def test_bins(bins, plain):
    values = {r[0]: r for r in _rows()}
    assert bins.numeric["c"] == [5.0] and list(bins.numeric) == NUMERIC and bins.categorical == CATEGORICAL
    for r in plain:
        a, b = values[r.customerID][3:5]
        assert r.bins[0] == (-1 if a is None else sum(e < a for e in bins.numeric["a"]))
        assert r.bins[1] == sum(e < b for e in bins.numeric["b"])
        assert list(r.levels) == [x or "nan" for x in values[r.customerID][6:8]]


def _plain_tree(rows, g, h, rule, bins, tree):
    """(splits, sums) by trying every split of every node on its own rows."""
    splits, sums, todo, memo = {}, {}, [(1, list(range(len(rows))), 0)], {}
    sides = lambda at: (sum(g[i] for i in at), sum(h[i] for i in at), len(at))
    score = lambda s: float(rule.score(np.array(s)))
    while todo:
        node, at, depth = todo.pop()
        sums[node] = sides(at)
        if depth == rule.max_depth:
            continue
        found = []
        tries = [("num__" + c, j, e, None) for j, c in enumerate(bins.numeric) for e in {rows[i].bins[j] for i in at} if e >= 0]
        tries += [(f"cat__{c}_{v}", j, None, v) for j, c in enumerate(bins.categorical) for v in {rows[i].levels[j] for i in at}]
        for name, j, edge, level in tries:
            if not rule.takes(memo, tree, node, name):
                continue
            for nulls_left in (True, False):
                goes = [(rows[i].levels[j] != level) if edge is None else
                        (nulls_left if rows[i].bins[j] < 0 else rows[i].bins[j] <= edge) for i in at]
                left, right = [i for i, x in zip(at, goes) if x], [i for i, x in zip(at, goes) if not x]
                one, two = sides(left), sides(right)
                if min(one[1], two[1]) / ht.UNIT < rule.min_h or min(one[2], two[2]) < rule.min_rows:
                    continue
                gain = score(one) + score(two) - score(sums[node])
                found.append((-gain, name, -1 if edge is None else edge, not nulls_left, left, right))
        best = min(found, key=lambda f: f[:4], default=None)
        if best and -best[0] > rule.gamma:
            splits[node] = (best[1], best[2], not best[3])
            todo += [(2 * node, best[4], depth + 1), (2 * node + 1, best[5], depth + 1)]
    return splits, sums


def _as_plain(tree):
    return {n: (s.feature, -1 if s.bin is None else s.bin, s.missing_left) for n, s in tree.splits.items()}, tree.sums


def test_boosted_trees_against_plain_python(table, bins, plain):
    settings = bo.Settings(rounds=3, max_depth=3, learning_rate=0.3, subsample=0.7, colsample=0.6, min_child_weight=2.0)
    model = bo.fit_boosting(table.where("split = 'train'"), settings=settings, bins=bins)
    weight = sum(r.y == 0 for r in plain) / sum(r.y == 1 for r in plain)
    assert model.weight == weight and len(model.trees) == 3 and model.auc == []
    margin = np.zeros(len(plain))
    for t, tree in enumerate(model.trees):
        a, b = ht.draw_numbers(t)
        take = [i for i, r in enumerate(plain) if (r.u * a + b) % ht.WORD < int(0.7 * ht.WORD)]
        p = 1 / (1 + np.exp(-margin))
        y = np.array([r.y for r in plain])
        w = np.where(y == 1, weight, 1.0)
        g, h = (np.rint(x * ht.UNIT).astype(int).tolist() for x in (w * (p - y), w * p * (1 - p)))
        want = _plain_tree([plain[i] for i in take], [g[i] for i in take], [h[i] for i in take],
                           settings.rule(), bins, t)
        assert _as_plain(tree) == want
        for node, value in tree.values.items():
            assert value == -0.3 * (want[1][node][0] / ht.UNIT) / (want[1][node][1] / ht.UNIT + 2.0)
        margin = margin + _plain_values(tree, plain)
    got = {r.customerID: r.prob for r in bo.score_boosting(model, table).collect()}
    assert all(abs(got[r.customerID] - 1 / (1 + math.exp(-m))) < 1e-12 for r, m in zip(plain, margin))


def _plain_values(tree, rows):
    out = []
    for r in rows:
        node = 1
        while node in tree.splits:
            s = tree.splits[node]
            if s.bin is None:
                left = r.levels[CATEGORICAL.index(s.column)] != s.level
            else:
                x = r.bins[NUMERIC.index(s.column)]
                left = s.missing_left if x < 0 else x <= s.bin
            node = 2 * node + (not left)
        out.append(tree.values[node])
    return np.array(out)


def test_trees_do_not_depend_on_partitions_or_refreshes(table, bins, monkeypatch):
    settings = bo.Settings(rounds=4, max_depth=3)
    train = table.where("split = 'train'")
    one = bo.fit_boosting(train, settings=settings, bins=bins)
    monkeypatch.setattr(bo, "REFRESH", 2)
    two = bo.fit_boosting(train.repartition(5), settings=settings, bins=bins)
    assert [_as_plain(t) for t in one.trees] == [_as_plain(t) for t in two.trees]


def test_forest_against_plain_python(table, bins, plain):
    train = table.where("split = 'train'")
    settings = fo.ForestSettings(trees=4, max_depth=3, min_leaf=5)
    model = fo.fit_forest(train, settings, bins)
    columns = len(NUMERIC) + len({r.levels[0] for r in plain}) + len({r.levels[1] for r in plain})
    rule = ht.Rule(False, 3, min_rows=5, columns=math.sqrt(columns) / columns, by_node=True)
    for t, tree in enumerate(model.trees):
        a, b = ht.draw_numbers(t)
        k = [sum((r.u * a + b) % ht.WORD >= bound for bound in fo.COPIES) for r in plain]
        n = [sum(c for c, r in zip(k, plain) if r.y == y) for y in (0, 1)]
        assert model.weights[t] == pytest.approx((sum(n) / 2 / n[0], sum(n) / 2 / n[1]))
        at = [i for i, c in enumerate(k) if c]
        h = [round(k[i] * model.weights[t][plain[i].y] * ht.UNIT) for i in at]
        want = _plain_tree([plain[i] for i in at], [x if plain[i].y else 0 for i, x in zip(at, h)], h, rule, bins, t)
        assert _as_plain(tree) == want
    probs = np.mean([_plain_values(t, plain) for t in model.trees], axis=0)
    got = {r.customerID: r.prob for r in fo.score_forest(model, train).collect()}
    assert all(abs(got[r.customerID] - p) < 1e-12 for r, p in zip(plain, probs))
    assert all(0 <= p <= 1 for p in got.values())


def test_copies_are_poisson():
    u = np.arange(0, ht.WORD, 20_011, dtype=np.int64)
    k = fo.copies_of(u, 7)
    for n in range(4):
        assert abs((k == n).mean() - math.exp(-1) / math.factorial(n)) < 0.01


def test_early_stopping(spark):
    def best(auc, patience):
        rows = bo.best_round(spark.createDataFrame(list(enumerate(auc, 1)), "round int, auc double"), patience).collect()
        kept = [r["round"] for r in rows if r.best]
        assert len(kept) == 1
        return kept[0], sum(r.used for r in rows)

    assert best([0.5, 0.6, 0.6, 0.59, 0.58, 0.9], 3) == (2, 5)  # stops before the late best one
    assert best([0.5, 0.6, 0.6, 0.59, 0.58, 0.9], 4) == (6, 6)
    assert best([None, None], 1) == (1, 2)
    assert best([0.4], 5) == (1, 1)
    assert bo._ended([0.5, 0.6, 0.6, 0.59, 0.58], 3) and not bo._ended([0.5, 0.6, 0.6, 0.59], 3)


def test_fit_stops_and_keeps_the_best_prefix(table, bins, monkeypatch):
    monkeypatch.setattr(bo, "REFRESH", 3)
    train, val = (table.where(F.col("split") == s) for s in ("train", "val"))
    model = bo.fit_boosting(train, val, bo.Settings(rounds=12, max_depth=2, patience=2), bins)
    assert len(model.auc) in range(len(model.trees), 13)
    assert model.auc[len(model.trees) - 1] == max(model.auc[:len(model.trees) + 2])
    scored = bo.score_boosting(model, val)
    from churnscope.operators.evaluate import roc_auc
    assert roc_auc(scored).first()["auc"] == pytest.approx(model.auc[len(model.trees) - 1], abs=1e-12)  # G3 on the same rows


def _plain_shapley(tree, row):
    """Contributions by all subsets of the tree's columns, unknown ones weighted by cover."""
    def known(node, have):
        s = tree.splits.get(node)
        if s is None:
            return tree.values[node]
        if s.feature in have:
            if s.bin is None:
                left = row.levels[CATEGORICAL.index(s.column)] != s.level
            else:
                x = row.bins[NUMERIC.index(s.column)]
                left = s.missing_left if x < 0 else x <= s.bin
            return known(2 * node + (not left), have)
        cover = [tree.sums[2 * node + i][1] for i in (0, 1)]
        return (cover[0] * known(2 * node, have) + cover[1] * known(2 * node + 1, have)) / tree.sums[node][1]

    features = sorted({s.feature for s in tree.splits.values()})
    out = dict.fromkeys(features, 0.0)
    for f in features:
        rest = [x for x in features if x != f]
        for size in range(len(rest) + 1):
            w = math.factorial(size) * math.factorial(len(rest) - size) / math.factorial(len(features))
            for some in itertools.combinations(rest, size):
                out[f] += w * (known(1, {*some, f}) - known(1, set(some)))
    return out


def test_shapley_values_against_all_subsets(table, bins, plain):
    model = bo.fit_boosting(table.where("split = 'train'"), settings=bo.Settings(rounds=2, max_depth=4, min_child_weight=1.0),
                            bins=bins)
    want = {}
    for r in plain[:40]:
        for tree in model.trees:
            for f, v in _plain_shapley(tree, r).items():
                want[r.customerID, f] = want.get((r.customerID, f), 0.0) + v
    ids = [r.customerID for r in plain[:40]]
    rows = bo.contributions(model, table.where(F.col("customerID").isin(ids))).collect()
    assert {(r.customerID, r.feature) for r in rows} == set(want)
    assert all(abs(r.contribution - want[r.customerID, r.feature]) < 1e-9 for r in rows)
    for who in ids:
        mine = [r for r in rows if r.customerID == who]
        assert sum(r.contribution for r in mine) + mine[0].expected == pytest.approx(mine[0].margin, abs=1e-9)


def test_open_vocabulary_and_empty_tables(spark, bins, table):
    many = spark.range(4000).select(F.col("id").cast("string").alias("customerID"), F.lit("train").alias("split"),
                                    (F.col("id") % 2).cast("int").alias("ChurnFlag"), F.lit(1.0).alias("a"),
                                    F.concat(F.lit("level"), "id").alias("k"))
    b = ht.fit_bins(many, 4, ["a"], ["k"])
    model = bo.fit_boosting(many, settings=bo.Settings(rounds=1, min_child_weight=0.0), bins=b)
    assert model.trees[0].sums[1][2] == pytest.approx(3200, abs=100) and len(model.trees[0].splits) > 0
    none = bo.fit_boosting(table.where("false"), settings=bo.Settings(rounds=1), bins=bins)
    assert none.trees[0].splits == {} and none.trees[0].values == {}
    assert [r.prob for r in bo.score_boosting(none, table.limit(2)).collect()] == [0.5, 0.5]


def test_rows_are_packed_for_every_core_and_sums_go_out_by_column(spark, table, bins):
    """One file of few bytes was read by one task, and each task gave a row for every sum."""
    data = ht.packed(ht.binned(table.coalesce(1), bins), bins)
    assert data.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    settings = bo.Settings(max_depth=1)
    sums = ht._histograms(data.coalesce(1), bins, {0: ht.Tree()}, {0: [1]}, bo.subsample(settings),
                          bo.gradient_stats([], 1.0), settings.rule()).collect()
    assert sorted(r.place for r in sums) == list(range(len(NUMERIC) + len(CATEGORICAL)))
    rows = {sum(np.frombuffer(r.n, np.int64)) for r in sums}
    assert len(rows) == 1 and 0 < rows.pop() <= len(_rows())


def test_nodes_that_no_split_fits_take_no_part():
    forest = ht.Rule(False, 3, min_rows=5)
    assert forest.may_split(3, 10, 10) and not forest.may_split(3, 10, 9)
    assert not forest.may_split(0, 10, 10) and not forest.may_split(10, 10, 10)
    assert bo.Settings().rule().may_split(0, 8 * ht.UNIT, 2) and not bo.Settings().rule().may_split(0, 7 * ht.UNIT, 9)
