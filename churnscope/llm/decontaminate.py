"""Benchmark decontamination over a stored positional inverted index.

``build_index`` turns the documents into a distributed index: rows are cut
into blocks of ``INDEX_BYTES`` of text, and each block is one row that holds
its distinct words, the sorted positions of each (a posting list) and where
its documents begin.  Positions of different documents lie ``GAP`` apart, so
no match crosses documents.  The index does not depend on any benchmark; it is
written to the shared folder in row groups of a few blocks, so a task holds no more
than these, and lost tasks read it again.

``search`` looks for phrases.  A phrase is searched in a block by taking the
posting list of its rarest term there, moving it by the term's offset, and
intersecting it with the moved lists of the other terms from the rarest on; a
phrase with a term the block does not know ends at once.  ``proximity`` finds
stretches of bounded width that hold all terms of an item in any order.  Work
is per block, so neither a frequent word nor a copied document meets in one
task.  The test items are broadcast in parts of ``PART_BYTES`` of text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  A
window is ``width`` consecutive words of an item; an item of fewer words, but
not none, is one window.

Edge cases: null and empty texts have no words (documents keep their row,
items match nothing); repeated document rows are judged each; repeated items
count once by id; an item without id is listed as ``null``; an empty benchmark
hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.textblock import ALNUM, blocks, split_words
from churnscope.session import LARGE_ROWS, stash

WIDTH = 10
#: Positions between documents; phrases and proximity windows are shorter.
GAP = 64
#: Text of a block: a row of the index, and the arrays that hold it in a task, stay below a megabyte or so.
INDEX_BYTES = 1 << 19
PART_BYTES = 16 << 20

INDEX_SCHEMA = ("doc_ids array<long>, lengths array<int>, terms array<binary>, "
                "starts array<int>, positions array<int>")
MATCH_SCHEMA = ("doc_id long, n_words long, n_hit long, items array<string>, "
                "spans array<struct<begin:int,end:int>>")


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per block of documents: its words with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=INDEX_BYTES):
            words = split_words(block.column(1), ALNUM)
            lengths = np.diff(words.offsets)
            at = np.arange(len(words.codes)) + np.repeat(np.arange(len(lengths)) * GAP, lengths)
            order = np.argsort(words.codes, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(words.codes, minlength=len(words.terms)))))
            yield pa.RecordBatch.from_arrays([
                pa.array([block.column(0)], pa.list_(pa.int64())),
                pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array([0, len(words.terms)], pa.int32()), words.terms),
                pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([at[order].astype(np.int32)], pa.list_(pa.int32())),
            ], ["doc_ids", "lengths", "terms", "starts", "positions"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    return stash(rows.mapInArrow(run, INDEX_SCHEMA), "positional-index", options=LARGE_ROWS)


class Part:
    """Items of one part of the benchmark as windows over a vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        words = split_words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.names = [n for n, _ in items]
        self.terms = words.terms.to_pylist()
        self.items = [words.codes[a:b] for a, b in zip(words.offsets, words.offsets[1:])]
        found: dict[tuple, set[int]] = {}
        for i, codes in enumerate(self.items):
            for a in range(max(1, len(codes) - width + 1)) if len(codes) else ():
                found.setdefault(tuple(codes[a:a + width].tolist()), set()).add(i)
        self.groups = []  # by length: (terms of each window, its items)
        for size in sorted({len(w) for w in found}):
            some = [w for w in found if len(w) == size]
            self.groups.append((np.array(some, np.int64), [sorted(found[w]) for w in some]))


class Block:
    """Posting lists of one index row, addressed by the terms of a part."""

    def __init__(self, row: dict, terms: list[bytes]):
        self.lengths = row["lengths"].astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.lengths)))[:-1] + np.arange(len(self.lengths)) * GAP
        place = pa.array(terms, pa.binary())
        at = pa.compute.index_in(place, value_set=row["terms"]).fill_null(-1).to_numpy()
        self.at, self.starts, self.positions = at, row["starts"], row["positions"]
        self.counts = np.where(at >= 0, self.starts[at + 1] - self.starts[at], 0) if len(self.starts) > 1 \
            else np.zeros(len(at), np.int64)

    def postings(self, term: int) -> np.ndarray:
        a = self.at[term]
        return self.positions[self.starts[a]:self.starts[a + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions where the terms stand in a row."""
        order = np.argsort(self.counts[terms], kind="stable")
        found = self.postings(terms[order[0]]) - int(order[0])
        for k in order[1:]:
            if not len(found):
                break
            other = self.postings(terms[k])
            wanted = found + int(k)
            place = np.searchsorted(other, wanted)
            place[place == len(other)] = 0
            found = found[other[place] == wanted]
        return found

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Positions from which ``within`` positions hold all distinct terms."""
        distinct = np.unique(terms)
        if not len(distinct) or (self.counts[distinct] == 0).any():
            return np.zeros(0, np.int64)
        lists = [self.postings(t).astype(np.int64) for t in distinct[np.argsort(self.counts[distinct])]]
        begin = np.unique(np.concatenate([lists[0] - d for d in range(within)]))
        for other in lists[1:]:
            place = np.searchsorted(other, begin)
            ok = place < len(other)
            begin = begin[ok][other[place[ok]] < begin[ok] + within]
        return begin

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, positions, side="right") - 1


def _parts(benchmark: DataFrame, id_column: str, text_column: str, width: int) -> list:
    """The benchmark as broadcast parts, each of a checked size."""
    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"),
                            F.col(text_column).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // PART_BYTES)
    out = []
    for i in range(n):
        some = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()
        if some:
            out.append(benchmark.sparkSession.sparkContext.broadcast(
                Part(sorted({(r.item, r.text) for r in some}, key=lambda x: (x[0], x[1] or "")), width)))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].values for name in batch.schema.names}
            yield {k: v if k in ("terms", "doc_ids") else v.to_numpy() for k, v in row.items()}


def search(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_column: str = "item_id",
           text_column: str = "text") -> DataFrame:
    """For each document its words, hit words, items with occurring windows and hit spans."""
    if not 0 < width <= GAP:
        raise ValueError(f"width must be 1 to {GAP}")
    parts = _parts(benchmark, id_column, text_column, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n = len(row["lengths"])
            end = int(row["lengths"].sum()) + n * GAP
            edges = np.zeros(end + 1, np.int32)
            items: list[set[str]] = [set() for _ in range(n)]
            for part in parts:
                block = Block(row, part.value.terms)
                for windows, owners in part.value.groups:
                    for w in np.flatnonzero(block.counts[windows].min(axis=1) > 0):
                        at = block.phrase(windows[w])
                        if not len(at):
                            continue
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + windows.shape[1], -1)
                        names = [part.value.names[i] for i in owners[w]]
                        for doc in np.unique(block.document(at)):
                            items[doc].update(names)
            hit = np.cumsum(edges[:-1]) > 0
            lengths = row["lengths"].astype(np.int64)
            base = np.concatenate(([0], np.cumsum(lengths)))[:-1] + np.arange(n) * GAP
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[base + lengths] - total[base]
            turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            begins, ends = turns[::2], turns[1::2]
            owner = np.searchsorted(base, begins, side="right") - 1
            spans: list[list[dict]] = [[] for _ in range(n)]
            for d, a, b in zip(owner.tolist(), begins.tolist(), ends.tolist()):
                spans[d].append({"begin": a - int(base[d]), "end": b - int(base[d])})
            yield pa.RecordBatch.from_arrays([
                row["doc_ids"], pa.array(lengths), pa.array(n_hit.astype(np.int64)),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            ], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return index.mapInArrow(run, MATCH_SCHEMA)


def proximity(index: DataFrame, benchmark: DataFrame, within: int = GAP, id_column: str = "item_id",
              text_column: str = "text") -> DataFrame:
    """(doc_id, item, begin): places where ``within`` words hold all terms of an item."""
    if not 0 < within <= GAP:
        raise ValueError(f"within must be 1 to {GAP}")
    parts = _parts(benchmark, id_column, text_column, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = row["doc_ids"].to_pylist()
            out = []
            for part in parts:
                block = Block(row, part.value.terms)
                for name, codes in zip(part.value.names, part.value.items):
                    at = block.near(codes, within)
                    doc = np.searchsorted(block.base, at + within - 1, side="right") - 1
                    at = np.maximum(at, block.base[doc])
                    first = np.ones(len(at), bool)
                    first[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) > 1)  # one for each run of places
                    out += [(ids[d], name, int(p - block.base[d]))
                            for d, p in zip(doc[first], at[first])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()),
                 pa.array([x[2] for x in out], pa.int32())], ["doc_id", "item", "begin"])

    return index.mapInArrow(run, "doc_id long, item string, begin int").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Index ``docs`` and search the windows of ``benchmark`` in them."""
    return search(build_index(docs), benchmark, width)
