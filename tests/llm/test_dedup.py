"""Suffix-array and MinHash dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from churnscope.llm import components as components_module, near_dedup, repeats
from churnscope.llm.components import components
from churnscope.llm.suffix_sort import sort_suffixes
from churnscope.session import stash
from churnscope.sources.tables import table_path
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(table_path(SF_SMALL, "documents")).select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows]
    return rows + [(5000, None), (5001, ""), (5002, "ab" * 300), (5003, "x" * 1000), (None, rows[3][1]),
                   (5004, rows[5][1]), (5004, rows[5][1]), (5004, "z" * 199), (5005, "é" * 150),
                   (5006, rows[7][1] * 40)]


def test_suffix_order():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, depth = int(rng.integers(70, 400)), int(rng.integers(8, 60))
        text = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        text[n // 2:n // 2 + n // 4] = text[:n // 4]
        if trial % 5 == 0:
            text[rng.random(n) < 0.05] = 250
        starts = rng.permutation(n - depth + 1)
        order, head = sort_suffixes(text, starts, depth, shallow=int(rng.choice([8, 16, 32])))
        strings = [text[i:i + depth].tobytes() for i in starts[order]]
        assert strings == sorted(strings) and sorted(order.tolist()) == list(range(len(starts)))
        assert head.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]


def _brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,split,few", [(200, 4000, 10 ** 6), (200, 2, 10 ** 6), (90, 3, 0)])
def test_repeats_match_brute_force(spark, texts, monkeypatch, length, split, few):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", few)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
           for r in repeats.dedup(df, length=length, split=split).collect()]
    want = [(a, *b) for (a, _), b in zip(texts, _brute_repeats([t for _, t in texts], length))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_bytes string, spans string")
    assert repeats.dedup(df).count() == 0


def _sets(texts, size):
    out = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
                 .replace("\r", " ").split(" ") if w]
        out.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def _brute_groups(rows, size):
    sets = _sets([t for _, t in rows], size)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and both:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least.get(find(i)) if s else doc, doc == (least.get(find(i)) if s else doc))
            for i, ((doc, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("size,few", [(2, 10 ** 6), (5, 0)])
def test_near_groups_match_brute_force(spark, texts, monkeypatch, size, few):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(size)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 120)]
    family = []
    for k in range(60):  # around the similarity, linked and unlinked
        some = list(base)
        for i in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            some[i] = words[rng.integers(0, 400)]
        family.append((9000 + k, " ".join(some)))
    rows = texts + family + [(9100, "one"), (9101, "ONE"), (9102, " \t\n"), (9103, "one two"), (9104, "two\tone")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string")
    got = [tuple(r) for r in near_dedup.near_groups(df, shingle=size).collect()]
    assert sorted(got, key=str) == sorted(_brute_groups(rows, size), key=str)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    one, two = pool[:1000], pool[200:]
    sig = near_dedup.signatures(np.concatenate((one, two)), np.array([0, 1000, 2000]))
    agree = (sig[0] == sig[1]).mean()
    assert abs(agree - 800 / 1200) < 0.25


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (104, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).distinct().collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 102: 100, 104: 100} | {200 + i: 200 for i in range(30)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("module,run", [
    (near_dedup, lambda df: near_dedup.near_groups(df, shingle=2)), (repeats, lambda df: repeats.dedup(df))])
def test_no_table_is_broadcast_by_estimate(spark, texts, monkeypatch, module, run):
    """Exploded and compressed tables are estimated far too small: only counted ones may go through the driver."""
    plans = []

    def explained(df):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return df

    monkeypatch.setattr(module, "BROADCAST_ROWS", -1)  # none is counted as small
    for place in (near_dedup, repeats, components_module):
        monkeypatch.setattr(place, "stash", lambda df, *a, **b: stash(explained(df), *a, **b))
    explained(run(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
