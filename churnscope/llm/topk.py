"""Exact top-k search by distributed histogram selection.

Every query vector is scored against every other row (integer inner products
of ``floor(256 * x)``).  The kth score of each query is located by refining
global histograms: each task scores its rows and counts them in ``BINS`` bins
over the query's current interval, the counts are added up, and the bin that
holds the kth score becomes the next interval, until it is one integer wide.
A last pass keeps the rows above the kth score and, of the ties at it, the
smallest ids; a ranking of these few rows gives the result.

A task sends only the bins down to its own kth score (bins below cannot hold
the global kth) and at most ``k`` ties, so at most ``k`` counts and ``2k``
rows for each query leave a task, also if a third of all rows are one vector.
Queries are a fixed share of the rows and are broadcast in blocks of
``QUERY_BYTES``, with a round of passes for each block.

Edge cases: vectors that are null or hold a null or a non-finite component,
and rows without id, take no part; vectors of different lengths are not
scored against each other (an empty vector scores 0 with others); a repeated
id is one query, with the smallest of its vectors, its rows are no candidates
of it, and are each a candidate of the others; fewer than ``k`` candidates
are all returned; an empty table gives an empty result.  Components and
scores beyond a long are held at its limits.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.session import ensure_checkpoint_dir, stash

K = 5
EVERY = 50
SCALE = 256
BINS = 2048
QUERY_BYTES = 8 << 20
#: Scores that a task holds at once.
HELD = 1 << 21
LONG = (1 << 63) - 1


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.col("v")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (df.select(F.col(id_column).cast("long").alias("vec_id"),
                      F.col(vector_column).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .withColumn("v", F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact: as doubles while every sum stays below 2**53."""
    if rows.shape[1] == 0:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = max(abs(int(m)) for a in (queries, rows) for m in (a.max(initial=0), a.min(initial=0)))
    bound = most * most * rows.shape[1]
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.astype(object).T, -LONG, LONG).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: dict) -> Iterator[tuple]:
    """Blocks (places of queries, ids of rows, scores, own): own marks a query's own rows."""
    for batch in batches:
        column = batch.column(1)
        vec_ids, sizes = batch.column(0).to_numpy(), np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for size in np.unique(sizes):
            if int(size) not in vectors:
                continue
            places, queries = vectors[int(size)]
            mine = np.flatnonzero(sizes == size)
            step = max(1, HELD // len(places))
            for a in range(0, len(mine), step):
                some = mine[a:a + step]
                grid = flat[starts[some][:, None] + np.arange(size)].reshape(len(some), int(size))
                yield places, vec_ids[some], _scores(queries, grid), ids[places][:, None] == vec_ids[some]


def _block(rows: DataFrame, wanted: list, k: int) -> DataFrame:
    """Top k of the queries ``wanted`` (rows of vec_id, v) over ``rows``."""
    spark = rows.sparkSession
    ids = np.array([q.vec_id for q in wanted], np.int64)
    vectors = {}
    for size in {len(q.v) for q in wanted}:
        places = np.array([i for i, q in enumerate(wanted) if len(q.v) == size])
        vectors[size] = places, np.array([wanted[i].v for i in places], np.int64).reshape(len(places), size)
    shared = spark.sparkContext.broadcast((ids, vectors))
    # every score of a query lies within its interval [low, low + span)
    reach = rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))).first()[0]
    low, span = [], []
    for q in wanted:
        r = int(min(LONG, (sum(x * x for x in q.v) * (reach or 0.0)) ** 0.5 * 1.000001 + 2))
        low.append(-r)
        span.append(2 * r + 1)
    above = [0] * len(wanted)
    while max(span) > 1:
        widths = [-(-s // BINS) for s in span]
        state = spark.sparkContext.broadcast((low, widths, span, [k - a for a in above]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, vecs = shared.value
            lows, wide, spans, needs = state.value
            total: dict[int, dict[int, int]] = {}
            for places, _, scores, own in _scored(batches, held, vecs):
                for row, place in enumerate(places):
                    s = scores[row][~own[row]]
                    s = s[(s >= lows[place]) & (s <= lows[place] + (spans[place] - 1))]
                    bins = (s - lows[place]) // wide[place]  # scores above: counted before
                    if len(bins) > k:
                        bins = bins[bins >= np.partition(bins, len(bins) - k)[len(bins) - k]]
                    seen = total.setdefault(int(place), {})
                    for b, n in zip(*np.unique(bins, return_counts=True)):
                        seen[int(b)] = seen.get(int(b), 0) + int(n)
            out = []
            for place, seen in total.items():
                got = 0
                for b in sorted(seen, reverse=True):
                    out.append((place, b, seen[b], needs[place]))
                    got += seen[b]
                    if got >= k:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)],
                                             ["place", "bin", "n", "need"])

        counts = (rows.mapInArrow(count, "place long, bin long, n long, need long")
                  .groupBy("place", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need")))
        down = Window.partitionBy("place").orderBy(F.desc("bin"))
        holds = F.when(F.col("upto") >= F.col("need"), F.col("bin"))
        reached = {r.place: r for r in counts.withColumn("upto", F.sum("n").over(down))
                   .groupBy("place").agg(F.max(holds).alias("bin"),
                                         F.max_by(F.col("upto") - F.col("n"), holds).alias("before"))
                   .collect()}
        for i in range(len(wanted)):
            if span[i] <= 1:
                continue
            r = reached.get(i)
            if r is None or r.bin is None:  # fewer than k candidates: all are returned
                low[i], span[i] = -LONG - 1, 1
            else:
                low[i], span[i] = low[i] + r.bin * widths[i], widths[i]
                above[i] += r.before
    cuts = spark.sparkContext.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vecs = shared.value
        over, ties = [], {}
        for places, vec_ids, scores, own in _scored(batches, held, vecs):
            cut = np.array([cuts.value[p] for p in places], np.int64)[:, None]
            row, col = np.nonzero((scores > cut) & ~own)
            over.append((held[places[row]], vec_ids[col], scores[row, col]))
            row, col = np.nonzero((scores == cut) & ~own)
            for p in np.unique(row):
                near = np.concatenate((ties.get(places[p], ((),))[0], vec_ids[col[row == p]])).astype(np.int64)
                ties[places[p]] = np.sort(near)[:k], int(cut[p, 0])
        for place, (near, score) in ties.items():
            over.append((np.full(len(near), held[place]), near, np.full(len(near), score)))
        for query, vec, score in over:
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()),
                                              pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.mapInArrow(keep, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding",
          k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``is_query`` (over vec_id) selects."""
    spark = df.sparkSession
    rows = stash(quantised(df, id_column, vector_column), "topk-vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, size = queries.agg(F.count("*"), F.sum(F.size("v") * 8 + 64)).first()
    pieces = max(1, -(-(size or 0) // QUERY_BYTES))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    path = os.path.join(ensure_checkpoint_dir(spark), "stash", f"topk-{uuid.uuid4().hex}")
    for piece in range(pieces):
        wanted = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece).collect()
        if wanted:
            _block(rows, wanted, k).write.mode("append").parquet(path)
    return spark.read.parquet(path)
