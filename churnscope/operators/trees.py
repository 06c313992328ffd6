"""Binary trees grown level by level from histograms.

Numeric columns are cut once into bins at their quantiles; categorical columns
keep their levels as text, so no vocabulary is gathered.  A level of any number
of trees takes one pass:

1. each task sums a pair (g, h) and a row count by (tree, node, column, bin or
   level), for the design columns that the node draws, and gives out a row a (tree,
   node, column) with the sums that are not empty;
2. these are dealt by (tree, node, column), added up, run up over the bins, and
   every split is scored;
3. the best split of each node, one row a node and task, reaches the driver.

Nodes that no split can fit (too few rows, or one class under Gini) take no part.

Sums are in integers (g and h in units of 2**-24), so trees do not depend on how
rows are dealt.  A numeric split sends values up to the bin's edge left, and
nulls to the side that scores better; a level split sends the level right, as a
one-hot indicator does.  Equal scores go to the first design column by name, then
the lowest bin.

Binned rows are ``(customerID, y, u, margin, bins, levels)``: ``u`` is a number of 32
bits from the id, from which rows are drawn for each tree.  The training table holds
them packed, ``BLOCK_ROWS`` a row, as arrays by column and levels as numbers of the
block's own lists, so a pass reads arrays and no text; it is dealt to every core.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET
from churnscope.operators.explain import level_text
from churnscope.session import spread

UNIT = 1 << 24
BINS, ACCURACY = 64, 1_000_000
#: Rows of a packed block (a number of a level or bin fits 16 bits), and levels of a column up to which sums are dense.
BLOCK_ROWS, DENSE_LEVELS = 1 << 14, 512
#: Nodes whose splits a task scores, as far as there are cores.
TASK_NODES = 256
WORD = 1 << 32


@dataclass(frozen=True)
class Bins:
    """Right edges of the numeric columns' bins (values over the last edge are one more bin)."""

    numeric: dict[str, list[float]]
    categorical: list[str]


def fit_bins(train: DataFrame, bins: int = BINS, numeric=NUMERIC_FEATURES,
             categorical=CATEGORICAL_FEATURES) -> Bins:
    """Edges at the quantiles 1/bins, 2/bins, ... of the non-null values: one aggregate for all columns."""
    numeric = [c for c in numeric if c in train.columns]
    at = [i / bins for i in range(1, bins)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = train.agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile_approx(value(c), at, ACCURACY).alias(c) for c in numeric]).first()
    return Bins({c: sorted(set(row[c] or [])) for c in numeric}, [c for c in categorical if c in train.columns])


def binned(df: DataFrame, b: Bins, target: str = TARGET, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table as trees read them, and columns ``keep``."""
    edges = [np.array(e) for e in b.numeric.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            out = np.empty(x.shape, np.int16)
            for j, e in enumerate(edges):
                out[:, j] = np.where(np.isnan(x[:, j]), -1, np.searchsorted(e, x[:, j]))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(edges)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.zeros(batch.num_rows)), lists,
                 *batch.columns[4:]], ["customerID", "y", "u", "margin", "bins", "levels", *keep])

    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in b.numeric])
    rows = df.select(F.col("customerID").cast("string").alias("customerID"), F.col(target).cast("int").alias("y"),
                     id_word(F.col("customerID")).alias("u"), numbers.alias("x"),
                     F.array(*[level_text(c) for c in b.categorical]).alias("levels"), *keep)
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, "customerID string, y int, u long, margin double, bins array<short>, "
                                f"levels array<string>{more}")


def id_word(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def draw_numbers(tree: int) -> tuple[int, int]:
    """(a, b): a row's draw for a tree is (u * a + b) mod 2**32, uniform over rows."""
    return 2654435769 * (2 * tree + 1) % (1 << 31) | 1, (40503 * tree * tree + 12345) % WORD


def drawn(u: np.ndarray, tree: int) -> np.ndarray:
    a, b = draw_numbers(tree)
    return (u.astype(np.uint64) * np.uint64(a) + np.uint64(b)) % np.uint64(WORD)


# ---- trees on rows ---------------------------------------------------------------

@dataclass(frozen=True)
class Split:
    column: str
    feature: str          # the design column
    bin: int | None       # numeric: up to this bin goes left
    level: str | None     # categorical: this level goes right
    missing_left: bool
    gain: float


@dataclass
class Tree:
    """Nodes in heap order: 1 is the root, 2n and 2n + 1 the left and right child of n."""

    splits: dict[int, Split] = field(default_factory=dict)
    sums: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # g, h (units), rows
    values: dict[int, float] = field(default_factory=dict)               # of leaves


class Block:
    """Training rows as arrays: ``x`` has a row a column, the bins of the numeric columns (-1 is null), then the
    places of the categorical columns' levels in ``levels``."""

    def __init__(self, y: np.ndarray, u: np.ndarray, margin: np.ndarray, x: np.ndarray, levels: list[list[str]],
                 b: Bins):
        self.n, self.y, self.u, self.margin, self.x, self.levels = len(y), y, u, margin, x, levels
        self.columns = {c: j for j, c in enumerate([*b.numeric, *b.categorical])}
        self.code = {c: {v: i for i, v in enumerate(some)} for c, some in zip(b.categorical, levels)}

    def left(self, s: Split) -> np.ndarray:
        x = self.x[self.columns[s.column]]
        if s.bin is None:
            return x != self.code[s.column].get(s.level, -1)
        return np.where(x < 0, s.missing_left, x <= s.bin)

    def nodes(self, tree: Tree, rows: np.ndarray | None = None) -> np.ndarray:
        """Where each row (of ``rows``, if given) ends in the tree as far as it has grown."""
        rows = np.arange(self.n) if rows is None else rows
        at = np.ones(len(rows), np.int64)
        if not tree.splits:
            return at
        # a row goes left if its value lies in low..high (a level: if it does not)
        column, low, high, named = np.zeros((4, 2 * max(tree.splits) + 2), np.int64)
        column[:] = -1
        for node, s in tree.splits.items():
            column[node] = self.columns[s.column]
            if s.bin is None:
                low[node] = high[node] = self.code[s.column].get(s.level, -1)
                named[node] = 1
            else:
                low[node], high[node] = -1 if s.missing_left else 0, s.bin
        flat, moving = self.x.ravel(), np.arange(len(rows))
        while len(moving):
            node = at[moving]
            x = flat[column[node] * self.n + rows[moving]]
            right = ((x < low[node]) | (x > high[node])) != (named[node] == 1)
            node = 2 * node + right
            at[moving] = node
            inner = node < len(column)
            moving = moving[inner]
            moving = moving[column[node[inner]] >= 0]
        return at

    def values(self, tree: Tree) -> np.ndarray:
        known = np.zeros(2 * max(tree.values, default=1) + 2)
        for node, value in tree.values.items():
            known[node] = value
        return known[self.nodes(tree)]


def block_of(batch: pa.RecordBatch, b: Bins) -> Block:
    """The block of a batch of binned rows."""
    n, wide = batch.num_rows, len(b.categorical)
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(n, len(b.numeric))
    flat = pc.dictionary_encode(batch.column("levels").flatten())
    codes = flat.indices.to_numpy(zero_copy_only=False).reshape(n, wide)
    names, levels = flat.dictionary.to_pylist(), []
    x = np.empty((len(b.numeric) + wide, n), np.int16 if n <= BLOCK_ROWS else np.int32)
    x[:len(b.numeric)] = bins.T
    for j in range(wide):
        held = np.bincount(codes[:, j], minlength=len(names)) > 0
        levels.append([names[i] for i in np.flatnonzero(held)])
        x[len(b.numeric) + j] = (np.cumsum(held) - 1)[codes[:, j]]
    y, u, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "u", "margin"))
    return Block(y, u, margin, x, levels, b)


PACKED = "n int, y binary, u binary, margin binary, x binary, levels array<array<string>>"


def packed(rows: DataFrame, b: Bins) -> DataFrame:
    """Binned rows as a table of blocks, dealt evenly to all cores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                block = block_of(batch.slice(first, BLOCK_ROWS), b)
                cells = [block.y.astype(np.float64), block.u.astype(np.int64), block.margin.astype(np.float64),
                         block.x.astype(np.int16)]  # a null y is NaN, of neither class
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.n], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells],
                     pa.array([block.levels], pa.list_(pa.list_(pa.string())))],
                    ["n", "y", "u", "margin", "x", "levels"])

    return spread(rows).mapInArrow(run, PACKED)


def unpacked(batch: pa.RecordBatch, b: Bins) -> Iterator[Block]:
    """The blocks of a batch of binned rows or of packed ones."""
    if "x" not in batch.schema.names:
        if batch.num_rows:
            yield block_of(batch, b)
        return
    for i in range(batch.num_rows):
        y, u, margin = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (
            ("y", np.float64), ("u", np.int64), ("margin", np.float64)))
        x = np.frombuffer(batch.column("x")[i].as_buffer(), np.int16).reshape(-1, len(y))
        yield Block(y, u, margin, x, batch.column("levels")[i].as_py(), b)


# ---- growing ---------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """How splits are scored and which are allowed.

    ``second_order``: g and h are sums of gradients and hessians, a side scores g * g / (h + reg).  Otherwise g is
    the weight of the positive rows and h that of all, and a side scores as its Gini impurity falls.  Design
    columns are drawn with probability ``columns`` for each tree (``by_node``: for each node).
    """

    second_order: bool
    max_depth: int
    reg: float = 0.0
    min_h: float = 0.0
    min_rows: int = 1
    gamma: float = 1e-6
    columns: float = 1.0
    by_node: bool = False

    def score(self, sums: np.ndarray) -> np.ndarray:
        g, h = sums[0] / UNIT, sums[1] / UNIT
        if self.second_order:
            return g * g / (h + self.reg)
        return (g * g + (h - g) * (h - g)) / np.where(h > 0, h, 1.0)

    def may_split(self, g: int, h: int, n: int) -> bool:
        """Whether any split of a node with these sums can be allowed and gain."""
        return (n >= 2 * self.min_rows and h >= 2 * self.min_h * UNIT * (1 - 1e-9)
                and (self.second_order or 0 < g < h))

    def takes(self, memo: dict, tree: int, node: int, feature: str) -> bool:
        """Whether the tree (or node) draws the design column."""
        key = (tree, node, feature) if self.by_node else (tree, feature)
        if key not in memo:
            word = int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16)
            memo[key] = word < int(self.columns * WORD)
        return memo[key]

    def drawers(self, starts: dict, tree: int, nodes: list[int], feature: str) -> np.ndarray:
        """``takes`` of every one of a tree's nodes; ``starts`` keeps the hashes of what their keys begin with."""
        if not self.by_node:
            return np.full(len(nodes), self.takes({}, tree, nodes[0], feature))
        if tree not in starts:
            starts[tree] = [hashlib.md5(f"{tree}:{n}:".encode()) for n in nodes]
        words = np.empty(len(nodes), np.int64)
        name = feature.encode()
        for i, begun in enumerate(starts[tree]):
            digest = begun.copy()
            digest.update(name)
            words[i] = int.from_bytes(digest.digest()[:4], "big")
        return words < int(self.columns * WORD)


#: In a task: (g, h in units) of rows of a block for a tree, and which rows take part (None: all).
Taken = Callable[[Block, int], np.ndarray]
Stats = Callable[[Block, int, np.ndarray], tuple[np.ndarray, np.ndarray]]
PARTIAL = ("tree int, node int, place int, bins binary, levels array<string>, g binary, h binary, n binary")


class _Cells:
    """Sums of (g, h, rows) by (node, bin or level number) of a tree's column."""

    def __init__(self, nodes: int, wide: int):
        self.nodes, self.held, self.sparse = nodes, np.zeros((3, nodes, wide), np.int64), []

    def add(self, node: np.ndarray, cell: np.ndarray, g: np.ndarray, h: np.ndarray, wide: int) -> None:
        most = self.held.shape[2]
        if wide > max(most, DENSE_LEVELS):
            key, at = np.unique(node * wide + cell, return_inverse=True)
            self.sparse.append((key // wide, key % wide, *_sums(at, g, h, len(key))))
            return
        if wide > most:
            more = max(wide, 2 * most)
            self.held = np.concatenate((self.held, np.zeros((3, self.nodes, more - most), np.int64)), axis=2)
            most = more
        for held, some in zip(self.held, _sums(node * most + cell, g, h, self.nodes * most)):
            held += some.reshape(held.shape)

    def found(self) -> tuple[np.ndarray, ...]:
        """(node, cell, g, h, n) of the sums with rows, by node."""
        node, cell = np.nonzero(self.held[2])
        dense = (node, cell, *self.held[:, node, cell])
        if not self.sparse:
            return dense
        parts = [np.concatenate(c) for c in zip(dense, *self.sparse)]
        order = np.argsort(parts[0], kind="stable")  # sums of one cell may come in parts
        return tuple(p[order] for p in parts)


def _sums(cell: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> list[np.ndarray]:
    # whole numbers below 2**53: exact
    return [np.bincount(cell, w, size).astype(np.int64) for w in (g, h)] + [np.bincount(cell, minlength=size)]


def _histograms(data: DataFrame, b: Bins, trees: dict[int, Tree], frontier: dict[int, list[int]],
                taken: Taken, stats: Stats, rule: Rule) -> DataFrame:
    """Sums of g, h and rows by bin or level, one row a task and (tree, node, column) with rows.

    A root has all columns, and its sums with them.  Other nodes' sums are known: they have the numeric columns and
    the levels that they draw."""
    numeric, names = list(b.numeric), [*b.numeric, *b.categorical]
    wide = max((len(e) for e in b.numeric.values()), default=0) + 2  # a place for nulls, and one over the last edge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], _Cells] = {}
        places: dict[str, dict[str, int]] = {c: {} for c in b.categorical}  # the task's numbers of levels
        known: dict[str, list[str]] = {c: [] for c in b.categorical}
        starts: dict[int, list] = {}
        draws: dict[tuple[int, str], np.ndarray] = {}

        def draw(t: int, feature: str) -> np.ndarray:
            """Which nodes of the frontier draw the design column."""
            if (t, feature) not in draws:
                root = frontier[t] == [1]
                draws[t, feature] = np.ones(1, bool) if root else rule.drawers(starts, t, frontier[t], feature)
            return draws[t, feature]

        for batch in batches:
            for block in unpacked(batch, b):
                numbers = []
                for c, some in zip(b.categorical, block.levels):
                    for v in some:
                        if v not in places[c]:
                            places[c][v] = len(known[c])
                            known[c].append(v)
                    numbers.append(np.array([places[c][v] for v in some], np.int64))
                for t, wanted in frontier.items():
                    place = np.full(2 * max(wanted) + 2, -1)
                    place[wanted] = np.arange(len(wanted))
                    rows = np.flatnonzero(taken(block, t))
                    at = place[block.nodes(trees[t], rows)]
                    rows, at = rows[at >= 0], at[at >= 0]
                    g, h = (v.astype(np.float64) for v in stats(block, t, rows))
                    for j, c in enumerate(names):
                        x = block.x[j][rows].astype(np.int64)
                        if j < len(numeric):
                            here, x, most = draw(t, f"num__{c}"), x + 1, wide
                        else:
                            x, most = numbers[j - len(numeric)][x], len(known[c])
                            drawn_levels = np.stack([draw(t, f"cat__{c}_{v}") for v in known[c]])
                            here = drawn_levels.any(axis=0)
                        if here.all():
                            some = slice(None)
                        else:
                            some = here[at] if j < len(numeric) else drawn_levels[x, at]
                            if not some.any():
                                continue
                        if (t, j) not in sums:
                            sums[t, j] = _Cells(len(wanted), most)
                        sums[t, j].add(at[some], x[some], g[some], h[some], most)
        for (t, j), cells in sums.items():
            node, cell, *values = cells.found()
            if not len(node):
                continue
            c = names[j]
            if j >= len(numeric) and frontier[t] != [1]:  # levels that the node has not drawn
                drawn_levels = np.stack([draw(t, f"cat__{c}_{v}") for v in known[c]])
                some = drawn_levels[cell, node]
                node, cell, values = node[some], cell[some], [v[some] for v in values]
            yield _partial(t, j, np.array(frontier[t])[node], cell, values,
                           known[c] if j >= len(numeric) else None)

    return data.mapInArrow(run, PARTIAL)


def _partial(tree: int, place: int, node: np.ndarray, cell: np.ndarray, values: list[np.ndarray],
             levels: list[str] | None) -> pa.RecordBatch:
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    ends = np.append(start, len(node)).astype(np.int32)

    def lists(x: np.ndarray) -> pa.Array:
        x = np.ascontiguousarray(x, np.int64)
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends * 8), pa.py_buffer(x)])

    nothing = pa.nulls(len(start), pa.list_(pa.string()))
    named = nothing if levels is None else pa.ListArray.from_arrays(
        pa.array(ends), pa.array(levels, pa.string()).take(pa.array(cell)))
    bins = lists(cell - 1) if levels is None else pa.nulls(len(start), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(start), tree, np.int32)), pa.array(node[start].astype(np.int32)),
         pa.array(np.full(len(start), place, np.int32)), bins, named, *[lists(v) for v in values]],
        ["tree", "node", "place", "bins", "levels", "g", "h", "n"])


BEST = ("tree int, node int, gain double, feature string, column string, bin int, level string, missing_left boolean, "
        "left_g long, left_h long, left_n long, all_g long, all_h long, all_n long")


def best_splits(partial: DataFrame, b: Bins, rule: Rule,
                totals: dict[tuple[int, int], tuple[int, int, int]]) -> DataFrame:
    """The best split of each (tree, node) among a task's columns, with the node's sums and those of its left side.

    Partial sums are dealt by (tree, node, column).  ``totals`` are the sums of the nodes that are not roots.  A node
    that no split fits has a gain of minus infinity."""
    names = [*b.numeric, *b.categorical]
    keys = np.array(sorted(totals), np.int64).reshape(-1, 2)
    known = (keys[:, 0] << 32 | keys[:, 1], np.array([totals[t, n] for t, n in keys.tolist()], np.int64).reshape(-1, 3).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]  # sums: as many as bins and levels, not rows
        if held:
            yield _best(pa.Table.from_batches(held), names, rule, *known)

    cores = partial.sparkSession.sparkContext.defaultParallelism
    parts = min(2 * cores, 1 + len(totals) // TASK_NODES)  # only spreads the work
    return partial.repartition(parts, "tree", "node", "place").mapInArrow(run, BEST)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The whole numbers of a column of binaries, one after the other."""
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in column.chunks])


def _exploded(table: pa.Table) -> pa.Table:
    """A row a sum: (tree, node, place, bin, level, g, h, n)."""
    parts = []
    for named in (False, True):
        some = table.filter(pc.is_valid(table["levels"]) if named else pc.is_valid(table["bins"]))
        if not some.num_rows:
            continue
        times = pc.binary_length(some["n"]).to_numpy() // 8
        columns = {c: np.repeat(some[c].to_numpy(), times) for c in ("tree", "node", "place")}
        columns |= {"bin": pa.nulls(int(times.sum()), pa.int64()) if named else _numbers(some["bins"]),
                    "level": pc.list_flatten(some["levels"].combine_chunks()) if named
                    else pa.nulls(int(times.sum()), pa.string())}
        parts.append(pa.table(columns | {c: _numbers(some[c]) for c in "ghn"}))
    return pa.concat_tables(parts)


def _best(table: pa.Table, columns: list[str], rule: Rule, known: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    keys = ["tree", "node", "place", "bin", "level"]
    sums = _exploded(table).group_by(keys).aggregate([(c, "sum") for c in "ghn"])
    level = pc.dictionary_encode(sums.column("level").combine_chunks())
    levels = level.dictionary.to_pylist()
    tree, node, of = (sums.column(c).to_numpy() for c in ("tree", "node", "place"))
    code = level.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    bins = sums.column("bin").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((code, bins, of, node, tree))
    tree, node, of, code, bins = (x[order] for x in (tree, node, of, code, bins))
    sums = np.stack([sums.column(f"{c}_sum").to_numpy()[order] for c in "ghn"])
    fresh = np.ones(len(tree), bool)
    fresh[1:] = (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]) | (of[1:] != of[:-1])
    start, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    root = node == 1
    whole = np.add.reduceat(sums, start, axis=1)[:, group]
    if len(known):
        at = np.searchsorted(known, tree.astype(np.int64) << 32 | node).clip(max=len(known) - 1)
        whole = np.where(root, whole, totals[:, at])
    run_up = np.cumsum(sums, axis=1)
    upto = run_up - (run_up - sums)[:, start][:, group]
    named = code >= 0
    nulls = np.add.reduceat(np.where(~named & (bins < 0), sums, 0), start, axis=1)[:, group]
    left = np.where(named, whole - sums, upto)

    pair, which = np.unique(of.astype(np.int64) * (len(levels) + 1) + code + 1, return_inverse=True)
    features = [f"cat__{columns[p // (len(levels) + 1)]}_{levels[p % (len(levels) + 1) - 1]}"
                if p % (len(levels) + 1) else f"num__{columns[p // (len(levels) + 1)]}" for p in pair.tolist()]
    memo: dict[tuple, bool] = {}
    may = np.ones(len(tree), bool)
    for i in np.flatnonzero(root).tolist():  # what other nodes have not drawn is not here
        may[i] = rule.takes(memo, int(tree[i]), 1, features[which[i]])
    may &= named | (bins >= 0)
    gains = []
    for one in (left, left - np.where(named, 0, nulls)):
        other = whole - one
        fits = may.copy()
        for side in (one, other):
            fits &= (side[1] / UNIT >= rule.min_h) & (side[2] >= rule.min_rows)
        gain = rule.score(one) + rule.score(other) - rule.score(whole)
        gains.append(np.where(fits, gain, -np.inf))
    nulls_left = gains[0] >= gains[1]
    gain = np.maximum(*gains)
    left = np.where(nulls_left, left, left - np.where(named, 0, nulls))
    rank = np.unique(np.array(features), return_inverse=True)[1][which]
    order = np.lexsort((bins, rank, -gain, node, tree))
    first = np.ones(len(order), bool)
    first[1:] = (tree[order][1:] != tree[order][:-1]) | (node[order][1:] != node[order][:-1])
    at = order[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(tree[at]), pa.array(node[at]), pa.array(gain[at]), pa.array([features[which[i]] for i in at]),
         pa.array([columns[of[i]] for i in at]), pa.array(bins[at].astype(np.int32), mask=named[at]),
         pa.array([levels[code[i]] if code[i] >= 0 else None for i in at], pa.string()), pa.array(nulls_left[at]),
         *left[:, at], *whole[:, at]], [f.split()[0] for f in BEST.split(", ")])


def grow(data: DataFrame, b: Bins, numbers: list[int], taken: Taken, stats: Stats, rule: Rule,
         leaf: Callable[[int, int], float]) -> dict[int, Tree]:
    """Trees of these numbers, all of them a level a pass over the ``packed`` rows."""
    trees = {t: Tree() for t in numbers}
    frontier = {t: [1] for t in numbers}
    for _ in range(rule.max_depth):
        totals = {(t, n): trees[t].sums[n] for t, nodes in frontier.items() for n in nodes if n != 1}
        found = best_splits(_histograms(data, b, trees, frontier, taken, stats, rule), b, rule, totals).collect()
        best = {}
        for r in sorted(found, key=lambda r: (-r.gain, r.feature, -1 if r.bin is None else r.bin)):
            best.setdefault((r.tree, r.node), r)
        frontier = {}
        for _, r in sorted(best.items()):
            tree, total = trees[r.tree], (r.all_g, r.all_h, r.all_n)
            tree.sums.setdefault(r.node, total)
            if not r.gain > rule.gamma:
                continue
            left = (r.left_g, r.left_h, r.left_n)
            tree.splits[r.node] = Split(r.column, r.feature, r.bin, r.level, r.missing_left, r.gain)
            tree.sums[2 * r.node] = left
            tree.sums[2 * r.node + 1] = tuple(a - x for a, x in zip(total, left))
            hopeful = [n for n in (2 * r.node, 2 * r.node + 1) if rule.may_split(*tree.sums[n])]
            if hopeful:
                frontier.setdefault(r.tree, []).extend(hopeful)
        if not frontier:
            break
    for tree in trees.values():
        tree.values = {n: leaf(g, h) for n, (g, h, _) in tree.sums.items() if n not in tree.splits}
    return trees


def node_table(spark, trees: dict[int, Tree], b: Bins) -> DataFrame:
    """The trees as a table: one row a node."""
    rows = []
    for t, tree in trees.items():
        for node, (_, h, n) in tree.sums.items():
            s = tree.splits.get(node)
            edges = b.numeric.get(s.column, []) if s and s.bin is not None else []
            rows.append((t, node, s.feature if s else None, s.bin if s else None,
                         float(edges[s.bin]) if s and s.bin is not None and s.bin < len(edges) else None,
                         s.level if s else None, s.missing_left if s else None, s.gain if s else None,
                         tree.values.get(node), h / UNIT, n))
    return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, edge double, level string, "
                                       "missing_left boolean, gain double, value double, cover double, rows long")
