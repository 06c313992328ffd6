"""Product codes of vectors, by a lexicographic trie over distinct parts.

A vector is cut into ``PARTS`` equal consecutive parts; each part position has
a codebook of up to ``ENTRIES`` entries, refined by rounds of assignment and
averaging in integers.

* Rows stay where they are: a task takes its rows in blocks, reduces the parts
  of a position to the distinct ones with their counts, and sorts them, which
  lays their trie over dimensions out as runs of the sorted table.
* The trie is walked depth first, in batches of sibling nodes.  A node carries
  the squared distances of all entries over its prefix of dimensions, taken from
  its parent and one more dimension; parts with a common prefix share them.
* A leaf takes the argmin (ties to the lower index).  In a round, leaves add
  their part to the entry, weighted by its count; a task gives out one row an
  entry, and Spark adds these up.  Only the codebooks (``PARTS`` x ``ENTRIES``)
  reach the driver.

Arithmetic is in integers and exact.  Components are floor(scale * x), held to
+-2**28 so that a squared distance fits a long.

Edge cases: rows whose vector is null or holds a null or non-finite component
take no part, nor do vectors of another length than that of the smallest id; a
length that is no multiple of the parts is cut at floor(i * length / parts).
Rows of a null id come last and may serve as entries after all others; equal ids
follow in the order of their vectors.  Fewer rows than entries give shorter
codebooks, no rows an empty result.  Labels that are null are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.session import release, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUND = 1 << 28
#: Rows of a block, and trie nodes of a batch.
BLOCK, BATCH = 1 << 16, 1024
#: Labels whose sums (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, the dimensions that each shares with the row before, each
    row's place among them).  The first row shares -1."""
    n, width = parts.shape
    order = np.lexsort(parts.T[::-1]) if width else np.arange(n)
    rows = parts[order]
    differs = rows[1:] != rows[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else np.zeros(n - 1, np.int64)
    fresh = np.concatenate(([True], shared < width))
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(fresh) - 1
    return rows[fresh], np.concatenate(([-1], shared))[fresh], place


def nearest(rows: np.ndarray, shared: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct part its nearest entry and the squared distance to it.

    A trie node of depth d is a run of rows that share d dimensions; it begins at a row that shares fewer with
    the row before.  ``stack`` holds batches of siblings: depth, their first rows, the row behind the last, the
    distances of the batch above and each node's parent there.
    """
    width = rows.shape[1]
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if max(width, 1) * 4 * most * most < 1 << 31 else np.int64
    rows, columns = rows.astype(kind), np.ascontiguousarray(entries.T.astype(kind))
    place, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    stack = [(0, np.zeros(1, np.int64), len(rows), np.zeros((1, len(entries)), kind), np.zeros(1, np.int64))]
    while stack:
        depth, nodes, stop, above, parent = stack.pop()
        sums = above[parent]
        if depth:
            step = rows[nodes, depth - 1][:, None] - columns[depth - 1]
            step *= step
            sums += step
        if depth == width:
            place[nodes] = sums.argmin(axis=1)
            best[nodes] = sums[np.arange(len(nodes)), place[nodes]]
            continue
        begins = shared[nodes[0]:stop] <= depth
        begins[0] = True
        below = nodes[0] + np.flatnonzero(begins)
        owner = np.searchsorted(nodes, below, side="right") - 1
        for i in reversed(range(0, len(below), BATCH)):  # the first batch is taken next
            j = min(i + BATCH, len(below))
            stack.append((depth + 1, below[i:j], below[j] if j < len(below) else stop, sums, owner[i:j]))
    return place, best


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of rows and their vectors as a matrix."""
    held, n = [], 0

    def block() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        lists = table.column(column).combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        return table, flat.reshape(len(lists), -1).astype(np.int64)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def integers(df: DataFrame, id_column: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with integer components."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(
        F.lit(float(BOUND)), v.cast("double") * scale))).cast("int"))
    return df.where(x.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), held.alias("v"))


def _refined(rows: DataFrame, books: list[np.ndarray], cuts: list[int]) -> list[np.ndarray]:
    """The codebooks after one round over all rows."""
    parts, widest = len(books), max(b - a for a, b in zip(cuts, cuts[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for _, matrix in _blocks(batches, 0):
            for p, book in enumerate(books):
                distinct, shared, place = distinct_parts(matrix[:, cuts[p]:cuts[p + 1]])
                at, _ = nearest(distinct, shared, book)
                weight = np.bincount(place, minlength=len(distinct))
                counts[p] += np.bincount(at, weight, len(book)).astype(np.int64)
                for d in range(book.shape[1]):  # exact: below 2**28 * 2**17 in a block
                    sums[p][:, d] += np.bincount(at, weight * distinct[:, d], len(book)).astype(np.int64)
        out = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(parts)
               for e in np.flatnonzero(counts[p]).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

    wide = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(widest)]
    found = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy(
        "part", "entry").agg(F.sum("n").alias("n"), *wide).collect()
    books = [b.copy() for b in books]
    for r in found:
        width = books[r.part].shape[1]
        books[r.part][r.entry] = [int(r[f"s{d}"]) // int(r.n) for d in range(width)]
    return books


def _coded(rows: DataFrame, books: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """(vec_id, label, code, error) of all rows."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, matrix in _blocks(batches, 2):
            codes = np.zeros((len(matrix), len(books)), np.uint8)
            error = np.zeros(len(matrix), np.int64)
            for p, book in enumerate(books):
                distinct, shared, place = distinct_parts(matrix[:, cuts[p]:cuts[p + 1]])
                at, best = nearest(distinct, shared, book)
                codes[:, p] = at[place]
                error += best[place]
            code = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield from pa.table([table.column(0), table.column(1), code, pa.array(error)],
                                ["vec_id", "label", "code", "error"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
             ) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the rows that take part, as a written table, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: entries must be 1 to 256")
    rows = stash(integers(df, id_column, vector, label, scale), "part-integers")
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(first[0].v) if first else 0
    cuts = [i * width // parts for i in range(parts + 1)]
    start = [r.v for r in first if len(r.v) == width]
    start = np.array(start, np.int64).reshape(len(start), width)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:])]
    same = rows.where(F.size("v") == width)
    for _ in range(rounds if first else 0):
        books = _refined(same, books, cuts)
    coded = stash(_coded(same, books, cuts), "part-codes")
    release(rows)
    return coded, books


def books_digest(books: list[np.ndarray]) -> str:
    flat = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(flat.encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The coded rows with the errors of their label added up."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = stash(sums, "part-labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
