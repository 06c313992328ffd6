"""Suffix-array dedup: remove every byte that a repeated string covers.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else,
in the same document or another.  Strings are judged on the input, never cross
documents, and overlaps count.

1. Anchors (``anchors``): strings are grouped by a content-chosen anchor, one
   for about every ``LENGTH / 3`` bytes, so only runs of strings are shuffled.
   A run whose anchor occurs once holds no repeat.  If all runs of an anchor
   are equal, or a run itself occurs twice, all its strings are repeats.
2. Suffix arrays (``suffix_sort``): what is left are runs that share an anchor
   but differ, at the ends of copied passages and around edits.  One run of
   each content goes, with its bytes, to the task of its anchor; the task sorts
   the suffixes of many anchors deep-shallow, and neighbours that agree on
   ``LENGTH`` bytes are repeats.  As all strings of a run cover its anchor,
   what they cover is one stretch, and only its two ends are returned.
   The runs of an anchor with more than ``SPLIT`` of them are dealt to several
   tasks; each sorts its own, and digests of the distinct strings (one row for
   each, however often it occurs) are counted to find repeats across tasks.
3. Covered stretches return to their documents; documents without any keep
   their bytes where they are.

Edge cases: a null text counts as empty; texts shorter than ``LENGTH`` lose
nothing; repeated rows are copies and lose all their strings; rows are told
apart by id and content, so a null id or one with several texts is fine; an
empty table gives an empty result.  The kept text can be cut within a
character: ``kept`` is bytes, and ``kept_text`` drops the broken characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.anchors import anchor_runs
from churnscope.llm.suffix_sort import sort_suffixes
from churnscope.llm.textblock import blocks, buffer_of, trim
from churnscope.session import SORTED, release, stash

LENGTH = 200
#: Differing runs of one anchor that a task sorts together.
SPLIT = 4000
#: Bytes of runs that one suffix array holds, if no single anchor has more.
ARRAY_BYTES = 2 << 20
#: Documents whose ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

DOC = ["id0", "sum0"]  # the id (never null) and a hash of the text
RUN = "first int, last int, at int, mark long, all long"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """The runs of strings of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            offsets, data = buffer_of(block.column(1))
            found = anchor_runs(data, offsets, length)
            text = pa.array(found["text"])
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(text), block.column(2).take(text),
                 *(pa.array(found[k].astype(np.int32)) for k in ("first", "last", "at")),
                 *(pa.array(found[k].view(np.int64)) for k in ("mark", "all"))],
                ["id0", "sum0", "first", "last", "at", "mark", "all"])
        trim()

    return docs.select("id0", "text", "sum0").mapInArrow(run, f"id0 long, sum0 long, {RUN}")


def _bytes_of(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs listed with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column=0):
            offsets, data = buffer_of(block.column(0))
            lists = block.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            rows = lists.flatten()
            first, last = (rows.field(k).to_numpy() for k in ("first", "last"))
            begin = np.repeat(offsets[:-1], sizes) + first
            raw = data.tobytes()
            some = [raw[a:b] for a, b in zip(begin, begin + (last - first) + length)]
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(k) for k in ("mark", "all", "pieces", "piece")), pa.array(some, pa.binary())],
                ["mark", "all", "pieces", "piece", "bytes"])
        trim()

    return docs.select("text", "runs").mapInArrow(
        run, "mark long, all long, pieces long, piece long, bytes binary")


def _sorted(runs: DataFrame, length: int) -> DataFrame:
    """For each run its first and last repeat (null: none), and digests where an anchor is split.

    Rows of an anchor's piece are neighbours in their partition.
    """
    schema = "mark long, all long, low int, high int, open array<struct<place:int,digest:binary>>"
    opened = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.binary())]))

    def array(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(x[4]) for x in held])
        text = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        strings = sizes - length + 1
        owner = np.repeat(np.arange(len(held)), strings)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        starts = begin[owner] + place
        order, head = sort_suffixes(text, starts, length)
        alone = head.copy()
        alone[:-1] &= head[1:]
        repeats = np.ones(len(order), bool)
        repeats[order[alone]] = False
        low = np.full(len(held), np.iinfo(np.int64).max)
        high = np.full(len(held), -1)
        np.minimum.at(low, owner[repeats], place[repeats])
        np.maximum.at(high, owner[repeats], place[repeats])
        digests: list[list[dict]] = [[] for _ in held]
        split = np.array([x[2] > 1 for x in held])
        if split.any():  # one digest for each distinct string of a split anchor
            firsts = np.sort(order[head])
            for i in firsts[split[owner[firsts]]]:
                a = starts[i]
                digests[owner[i]].append({"place": int(place[i]), "digest": hashlib.blake2b(
                    text[a:a + length].tobytes(), digest_size=16).digest()})
        none = high < 0
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()),
             pa.array(np.where(none, 0, low).astype(np.int32), mask=none),
             pa.array(high.astype(np.int32), mask=none), pa.array(digests, opened)],
            ["mark", "all", "low", "high", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0], row[3]) != group:
                    if size >= ARRAY_BYTES:
                        yield array(held)
                        held, size = [], 0
                    group = row[0], row[3]
                held.append(row)
                size += len(row[4])
        if held:
            yield array(held)
        held.clear()
        trim()

    return runs.select("mark", "all", "pieces", "piece", "bytes").mapInArrow(run, schema)


def _kept(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed stretches); spans are (begin, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    begin = spans[fresh, 0]
    end = reach[np.concatenate((np.flatnonzero(fresh)[1:], [len(spans)])) - 1]
    out, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist()):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), int((end - begin).sum()), len(begin)


def removed_spans(docs: DataFrame, length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """Stretches that repeats cover, as a written table of (id0, sum0, spans).

    ``docs`` has id0, sum0 and text.
    """
    long = docs.where(F.octet_length("text") >= length)
    runs = _runs(long, length)
    states = stash(runs.groupBy("mark").agg(F.count("*").alias("n"), F.min("all").alias("one"),
                                            F.max("all").alias("two"))
                   .where("n > 1").select("mark", (F.col("one") == F.col("two")).alias("equal")), "repeat-marks")
    hit = runs.join(states.hint(SORTED), "mark")
    differ = ~F.col("equal")
    hit = stash(hit.select(*DOC, "first", "last", *(F.when(differ, F.col(c)).alias(c) for c in ("at", "mark", "all"))),
                "repeat-runs")
    equal, mixed = hit.where(F.col("mark").isNull()), hit.where(F.col("mark").isNotNull())
    kinds = stash(mixed.groupBy("mark", "all").agg(
        F.count("*").alias("n"), F.min(F.struct(*DOC, "first", "last")).alias("run")), "repeat-kinds")
    sizes = stash(kinds.groupBy("mark").agg(F.ceil(F.count("*") / F.lit(split)).cast("long").alias("pieces")),
                  "repeat-sizes")
    wanted = (kinds.join(sizes.hint(SORTED), "mark")
              .select("run.*", "mark", "all", "pieces", F.pmod("all", "pieces").alias("piece")))
    listed = stash(wanted.groupBy(*DOC).agg(F.collect_list(
        F.struct("first", "last", "mark", "all", "pieces", "piece")).alias("runs")), "repeat-wanted")
    texts = _of_these(long, listed).join(listed.hint(SORTED), DOC).dropDuplicates(DOC)
    dealt = _bytes_of(texts, length).repartition("mark", "piece").sortWithinPartitions("mark", "piece")
    found = stash(_sorted(dealt, length), "repeat-sorted")
    # strings that several pieces of a split anchor hold
    opened = found.select("mark", "all", F.explode("open").alias("o")).select("mark", "all", "o.place", "o.digest")
    twice = stash(opened.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest"),
                  "repeat-digests")
    across = opened.join(twice.hint(SORTED), "digest").select("mark", "all", F.col("place").alias("low"),
                                                 F.col("place").alias("high"))
    ends = stash(found.where(F.col("low").isNotNull()).select("mark", "all", "low", "high").union(across)
                 .groupBy("mark", "all").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                 .join(kinds.where("n = 1").select("mark", "all", "run").hint(SORTED), ["mark", "all"])
                 .select("run.id0", "run.sum0", (F.col("run.first") + F.col("low")).alias("begin"),
                         (F.col("run.first") + F.col("high") + length).alias("end")), "repeat-ends")
    several = (mixed.join(kinds.where("n > 1").select("mark", "all").hint(SORTED), ["mark", "all"])
               .select(*DOC, "first", "last"))
    whole = equal.select(*DOC, "first", "last").union(several)
    spans = whole.select(*DOC, F.col("first").alias("begin"), (F.col("last") + length).alias("end")).union(ends)
    out = stash(spans.groupBy(*DOC).agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "removed-spans")
    release(states, hit, kinds, sizes, listed, found, twice, ends)
    return out


def _of_these(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The documents of ``listed``, before any of their texts is shuffled if they are few."""
    ids = listed.select(*DOC)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint(SORTED), DOC, "left_semi")


def dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
          split: int = SPLIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: id, columns ``keep``, n_bytes, n_removed, n_spans, kept and kept_text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("id0"),
                     F.xxhash64(text).alias("sum0"), text.alias("text"),
                     F.struct(F.col(id_column), *keep).alias("row"))
    per_doc = removed_spans(docs, length, split)
    some = per_doc.select(*DOC)
    few = some.count() <= BROADCAST_ROWS
    hit = docs.join(F.broadcast(some) if few else some.hint(SORTED), DOC, "left_semi").join(per_doc.hint(SORTED), DOC)
    rest = docs.join(F.broadcast(some) if few else some.hint(SORTED), DOC, "left_anti")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column=0):
            offsets, data = buffer_of(block.column(0))
            raw, lists, out = data.tobytes(), block.column(1), []
            for i in range(block.num_rows):
                rows = lists[i].values
                pairs = np.stack([rows.field("begin").to_numpy(), rows.field("end").to_numpy()], axis=1)
                out.append(_kept(raw[offsets[i]:offsets[i + 1]], pairs))
            yield pa.RecordBatch.from_arrays(
                [block.column(2), pa.array(np.diff(offsets)), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.int64()), pa.array([x[0] for x in out], pa.binary()),
                 pa.array([x[0].decode("utf-8", "ignore") for x in out], pa.string())],
                ["row", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])
        trim()

    kind = docs.schema["row"].dataType.simpleString()
    changed = hit.select("text", "spans", "row").mapInArrow(
        cut, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    same = rest.select("row", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                       F.col("text").cast("binary").alias("kept"), F.col("text").alias("kept_text"))
    return changed.union(same).select("row.*", "n_bytes", "n_removed", "n_spans", "kept", "kept_text")
