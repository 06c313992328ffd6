"""Decontamination, exact top-k and WARC against brute force and round trips."""

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import functions as F

from churnscope.llm import decontaminate, topk, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, width):
    out = []
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for item, t in items:
            w = _words(t)
            windows = [w[i:i + width] for i in range(max(1, len(w) - width + 1))] if w else []
            for win in windows:
                for i in range(len(words) - len(win) + 1):
                    if words[i:i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        found.add("null" if item is None else str(item))
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


DOCS = [(1, "The quick BROWN fox, jumps over the lazy dog again and again and again"), (2, None), (3, ""),
        (4, "dog again"), (5, "again and again and again and again"), (5, "quick brown fox"), (None, "über naïve fox jumps"),
        (6, "x " * 30_000 + "the quick brown fox"), (7, "the quick brown"), (8, "fox jumps over")]
ITEMS = [(1, "the quick brown fox"), (2, "again"), (3, None), (4, ""), (None, "Naïve FOX"), (5, "again and again and"),
         (5, "again and again and"), (10, "lazy dog again and again and then"), (11, "zebra quick")]


def test_windows_match_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, items int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for width in (1, 3, 4):
        got = decontaminate.find_contamination(docs, bench, width).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=str) == \
            sorted(_brute(DOCS, ITEMS, width), key=str)
        assert all(sum(s.end - s.begin for s in r.spans) == r.n_hit for r in got)


def test_benchmark_in_parts_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PART_BYTES", 40)
    got = decontaminate.find_contamination(docs, bench, 3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=str) == sorted(_brute(DOCS, ITEMS, 3), key=str)
    assert {r.n_hit for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a b x x x x c"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    assert sorted((r.doc_id, r.item) for r in decontaminate.proximity(index, bench, 5).collect()) == [(1, "9"), (2, "9")]
    assert {r.doc_id for r in decontaminate.proximity(index, bench, 3).collect()} == {2}


def test_index_is_held_a_few_blocks_at_a_time(spark):
    """However much text a task has, its row groups hold a few blocks: a task that reads one holds all of it."""
    docs = spark.range(120).coalesce(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.conv(i * (F.col("id") + 7) % 9973, 10, 36))).alias("text"))
    index = decontaminate.build_index(docs)
    held = []
    for path in index.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        held += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert len(held) > 1 and max(held) <= 9 << 20
    assert max(sum(r.lengths) for r in index.select("lengths").collect()) <= 400_000  # a row's positions
    bench = spark.createDataFrame([("hit", "0 7 e")], "item_id string, text string")
    found = decontaminate.search(index, bench, 3)
    assert found.count() == 120 and {r.doc_id for r in found.where("n_hit > 0").collect()} == {0}


def _top(rows, k, every):
    clean = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, v in clean:
        first[i] = min(first.get(i, v), v)
    out = []
    for q, v in first.items():
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 500)]  # one vector many times: ties
    rows += [(600, None), (601, [None, 1.0]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, [1.0] * 6),
             (700, [1.0, 2.0]), (701, [2.0, 1.0]), (50, [1.0] * 6), (3, rows[3][1]), (750, [1e12] * 6), (800, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    want = _top(rows, 5, 50)
    got = topk.top_k(df.repartition(7), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == want
    monkeypatch.setattr(topk, "QUERY_BYTES", 400)
    monkeypatch.setattr(topk, "BINS", 8)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _pages():
    page = "<html><body>" + "some common boilerplate text " * 20 + "</body></html>"
    rows = [(i, f"http://h{i % 7}.com/{i}", page.replace("common", f"page {i}")) for i in range(60)]
    return rows + [(100, "http://a/ b\r\n", page), (101, None, page), (102, "http://c", None), (103, "http://d", ""),
                   (104, "http://e", "é" * 100_000), (105, "http://f", page), (105, "http://f", page), (106, "http://g", "x")]


def test_warc_round_trip(spark):
    rows = _pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")
    index = warc.write_warc(df, warc.archive_folder(spark))
    got = warc.read_warc(index.select("path").distinct()).collect()
    payload = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, p in payload.items():
        last[p] = max(last.get(p, i), i)
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows) and index.count() == len(rows)
    for r in got:
        p = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        if last[p] == r.page_id:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, p)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", last[p], None)
    # each record can be read alone, from its offset, with the dictionary of the leading frame
    for entry in index.collect()[:5]:
        with open(entry.path.removeprefix("file://"), "rb") as src:
            magic, size = struct.unpack("<II", src.read(8))
            assert magic == warc.DICT_MAGIC
            known = zstandard.ZstdCompressionDict(src.read(size))
            src.seek(entry.offset)
            raw = zstandard.ZstdDecompressor(dict_data=known).decompress(src.read(entry.length))
        assert warc.parse_record(raw)["page_id"] == entry.page_id


def test_warc_limits_and_empty_input(spark):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.round_trip(df, min_revisit_bytes=50, roll_bytes=2000).collect()}
    assert kinds[102] == kinds[103] == "response" and kinds[100] == "revisit"
    assert warc.round_trip(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "u", "tiny"), (None, "u", "tiny")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(few).collect()) == \
        [(0, "revisit", 1), (1, "response", None)]
