"""Conversation prefix trie, document fingerprints and vector codes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from churnscope.llm import part_codes, prefix_hash, prefix_trie
from churnscope.llm.shipping import ship


# ---- conversation prefix trie ---------------------------------------------------

def _brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        start = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(start, [])[:h] + ts[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(p)))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids.get(p, [])),
                    sum(q not in kids for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _trie(spark, rows, schema="conv_id long, turn long, role string, text string"):
    ship(spark)
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuild(prefix_trie.sequences(df))).collect()), key=str)


def _conversations(n, seed=5):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, 7)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["", None, "a", "née", "b" * 40])))
    return rows


def test_trie_against_brute_force(spark, monkeypatch):
    rows = _conversations(330) + [(500 + c, t, "user", f"same {t}") for c in range(3) for t in range(40)]
    rows += [(-7, 0, "user", "a"), (-100, 1, "user", "b"), (-100, None, "user", "a"), (None, 0, "user", "lost")]
    rows += [(900, t, "user", f"long {t}") for t in range(300)]
    want = _brute_trie(rows)
    assert _trie(spark, rows) == want
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)  # parents by a shuffle
    monkeypatch.setattr(prefix_trie, "RANGE_KEYS", 3)      # many more ranges, deep cuts
    assert _trie(spark, rows) == want


def test_trie_edges(spark):
    assert _trie(spark, []) == []
    lone = _trie(spark, [(101, 0, "user", "x")])  # its start is absent, and h takes its only turn or none
    assert lone == _brute_trie([(101, 0, "user", "x")])
    extra = [(1, 0, "user", "x", 9, "k"), (1, 0, "user", "x", 9, "k"), (2, None, None, None, None, None)]
    got = _trie(spark, extra, "conv_id long, turn long, role string, text string, ids int, key string")
    assert got == _brute_trie([r[:4] for r in extra])


def test_one_hot_group_of_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "OUT_ROWS", 7)
    rows = [(c, 0, "user", "hello") for c in range(1000)] + [(c, 1, "user", str(c % 3)) for c in range(1000)]
    assert _trie(spark, rows) == _brute_trie(rows)


@pytest.mark.parametrize("n", [3, 4, 5, 16, 17, 48, 49, 256])
def test_layouts_grow(n):
    layout, nodes = prefix_trie.Few(), {}
    for b in random.Random(n).sample(range(256), n):
        nodes[b] = object()
        layout = layout.put(b, nodes[b])
    assert layout.room == next(r for r in (4, 16, 48, 256) if n <= r)
    assert [layout.get(b) for b in range(256)] == [nodes.get(b) for b in range(256)]
    assert layout.children() == [nodes[b] for b in sorted(nodes)]
    again = object()
    b = min(nodes)
    assert layout.put(b, again) is layout and layout.get(b) is again


def test_edges_part_inside_a_turn():
    width = prefix_trie.WIDTH
    keys = [bytes([1] * (width - 1) + [x]) + bytes([2] * width) * k for x in range(60) for k in (0, 2, 3)]
    root = prefix_trie.Node(b"", 0, 0)
    for i, key in enumerate(keys):
        prefix_trie.insert(root, key, (1, i, "e"))
    closed, opened = prefix_trie.walk(root, {b"": 0})
    assert len(closed) == 60 * 4 and opened[0][:3] == (0, len(keys), 0) and opened[0][4:6] == (60, 60)
    assert isinstance(root.layout.children()[0].layout, prefix_trie.Full)  # the branch is at the last byte of an id


# ---- fingerprints ------------------------------------------------------------------

def test_spans_and_extensions_against_strings():
    draw = random.Random(3)
    one = "".join(draw.choice("ab") for _ in range(400)) + "é\U0001F600\0"
    two = one[50:300] + "".join(draw.choice("ab") for _ in range(90))
    a, b = (prefix_hash.PrefixHashes(prefix_hash.code_points(t)) for t in (one, two))
    for _ in range(300):
        i, j = draw.randrange(len(one) + 1), draw.randrange(len(two) + 1)
        n = draw.randint(0, min(len(one) - i, len(two) - j))
        assert a.equal(i, b, j, n) == (one[i:i + n] == two[j:j + n])
        same = 0
        while i + same < len(one) and j + same < len(two) and one[i + same] == two[j + same]:
            same += 1
        assert a.common(i, b, j) == same
    joined = a.spliced(100, prefix_hash.code_points(two[:30]))
    plain = prefix_hash.PrefixHashes(prefix_hash.code_points(one[:100] + two[:30]))
    assert joined.fingerprint() == plain.fingerprint()
    assert plain.fingerprint() != a.fingerprint()


def test_sample_is_that_of_all_spans():
    text = "abc" * 500 + "x" * 2000 + "the end of it"
    h = prefix_hash.PrefixHashes(prefix_hash.code_points(text))
    spans = {text[i:i + 24] for i in range(len(text) - 23)}
    every = sorted({int(prefix_hash.PrefixHashes(prefix_hash.code_points(s)).smallest(1)[0]) for s in spans})
    assert h.smallest().tolist() == every[:prefix_hash.SAMPLE]


def test_likeness():
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(600)]
    text = " ".join(words)
    print_of = lambda t: prefix_hash.PrefixHashes(prefix_hash.code_points(t)).fingerprint()
    like = lambda a, b: prefix_hash.likeness(print_of(a), print_of(b))
    assert like(text, text) == 1 and like("", "") == 1 and like("", text) == 0
    assert like(text, " ".join(reversed(words))) < 0.3
    assert like(text, text[:-200] + "z" * 200) > 0.8    # by the common prefix
    assert like(text, "zz " + text) > 0.8               # by the spans, which have moved
    assert 0 <= like("ab", "ac") <= 1
    assert like("x", "x" * 5) < 1 and like("x" * 3000, "x" * 2000) == 2 / 3  # the same spans, in texts of other lengths


def _brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, after)
    return out


def test_edits_against_brute_force(spark):
    ship(spark)
    draw = random.Random(6)
    rows = [(i * 3 - 40, "".join(draw.choice("abcé \U0001F600") for _ in range(draw.randint(0, 400)))) for i in range(200)]
    rows += [(10_000, None), (10_001, ""), (10_002, "z" * 200_000), (10_003, "same"), (10_004, "same"), (None, "no id")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, edge string, part int")
    got = {r.doc_id: r for r in prefix_hash.compare_edits(df.repartition(7)).collect()}
    want = _brute_edits(rows)
    assert len(got) == len(rows) and set(got) == set(want)
    texts = dict(rows)
    print_of = lambda t: prefix_hash.PrefixHashes(prefix_hash.code_points(t)).fingerprint()
    for doc, (n, sha, edited, after) in want.items():
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.fingerprint == print_of(texts[doc]) and r.edited_fingerprint == print_of(edited)
        assert r.near_edited == prefix_hash.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == prefix_hash.likeness(r.fingerprint, print_of(after))
        text = texts[doc] or ""
        same = next((i for i, (x, y) in enumerate(zip(text, edited)) if x != y), min(len(text), len(edited)))
        assert r.common_prefix == same
    assert got[10_003].fingerprint == got[10_004].fingerprint and got[10_004].near_next == 1


def test_edits_of_few_rows_and_bad_bytes(spark):
    ship(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_hash.compare_edits(none).collect() == []
    one = prefix_hash.compare_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(6, hashlib.sha256(b"abcdab").hexdigest())]
    bad = spark.sql("SELECT 1L AS doc_id, decode(X'61FF', 'ISO-8859-1') AS text UNION ALL "
                    "SELECT 2L, CAST(X'61FF62' AS STRING)")
    got = {r.doc_id: r.n_chars for r in prefix_hash.compare_edits(bad).collect()}
    assert got == {1: 2, 2: 3}
    twice = spark.createDataFrame([(1, "aaa"), (1, "bbb"), (1, "aaa")], "doc_id long, text string")
    assert len(prefix_hash.compare_edits(twice).collect()) == 3


# ---- vector codes ---------------------------------------------------------------------

def _brute_codes(rows, entries, parts=4, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    cuts = [i * width // parts for i in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cuts, cuts[1:])]

    def assign(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(assign(v[a:b], books[p])[0], []).append(v[a:b])
            for e, vs in groups.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)] if b > a else []
    out, by_label = [], {}
    for i, v, label in kept:
        got = [assign(v[a:b], book) for a, b, book in zip(cuts, cuts[1:], books)]
        error = sum(d for _, d in got)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{c:02x}" for c, _ in got), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[label]) for i, c, e, label in out], key=str), digest


def _codes(spark, rows, entries, schema="vec_id long, embedding array<float>, label int"):
    ship(spark)
    coded, books = part_codes.compress(spark.createDataFrame(rows, schema).repartition(3), entries=entries)
    out = part_codes.with_label_error(coded)
    return (sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str),
            part_codes.books_digest(books))


def test_codes_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in draw.choice([-1.5, -0.001, 0.0, 0.25, 0.2503, 2.0], 8)],
             [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(60)]  # copies
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1),
             (2004, [0.5] * 4, 1), (2005, [], 1), (None, [0.1] * 8, None), (3, [9.0] * 8, 5)]
    want = _brute_codes(rows, 9)
    assert _codes(spark, rows, 9) == want
    monkeypatch.setattr(part_codes, "BATCH", 3)
    monkeypatch.setattr(part_codes, "BLOCK", 20)
    monkeypatch.setattr(part_codes, "BROADCAST_ROWS", 0)
    assert _codes(spark, rows, 9) == want
    assert _codes(spark, rows, 256) == _brute_codes(rows, 256)


def test_codes_edges(spark):
    assert _codes(spark, [], 4) == ([], hashlib.sha256(b"").hexdigest())
    lone = [(5, [1.0, 2.0, 3.0, 4.0, 5.0], None)]  # parts of 1, 1, 1 and 2 components
    assert _codes(spark, lone, 4) == _brute_codes(lone, 4)
    assert _codes(spark, [(1, [1e30, -1e30, 0.0, 0.0], 1)], 4)[0] == [(1, "00000000", 0, 0)]
    wide = [(1, [0.5] * 4, 1, "x", 2)]
    got = _codes(spark, wide, 4, "vec_id long, embedding array<float>, label int, code string, error int")
    assert got[0] == [(1, "00000000", 0, 0)]


def test_shared_prefixes_are_taken_once():
    rows = np.array([[1, 1, 1], [1, 1, 2], [1, 1, 2], [0, 5, 5]], np.int64)
    distinct, shared, place = part_codes.distinct_parts(rows)
    assert distinct.tolist() == [[0, 5, 5], [1, 1, 1], [1, 1, 2]]
    assert shared.tolist() == [-1, 0, 2] and place.tolist() == [1, 2, 2, 0]
    at, best = part_codes.nearest(distinct, shared, np.array([[1, 1, 2], [0, 5, 5], [1, 1, 2]], np.int64))
    assert at.tolist() == [1, 0, 0] and best.tolist() == [0, 1, 0]
