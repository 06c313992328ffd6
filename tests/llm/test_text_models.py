"""Tokenizer, toxicity, language ID: public library, held-out accuracy, edge rows."""

import copy

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnscope.llm import langid, sentencepieces, toxicity
from churnscope.llm.textblock import ALNUM, SPACED, split_words
from churnscope.sources.tables import table_path
from tests.conftest import SF_SMALL

ODD = ["", "a", " ", "  ", " a  b", "Hello  world", "日本語テスト😀", "a▁b", "<s> <0x41>", "\x00\n\t", "x" * 50, "   lead",
       "trail   ", "é" * 9, "aaaaaaa aaa aaaa", " \n a", "日本" * 400, "ab" * 3000, "▁", "<unk>"]


@pytest.fixture(scope="module")
def model():
    return sentencepieces.read_model()


def test_same_ids_as_the_public_library(spark, model):
    import sentencepiece
    public = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ODD + [r.text for r in spark.read.parquet(table_path(SF_SMALL, "documents")).select("text").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, None)],
                               "doc_id long, text string, ids string")
    coded = sentencepieces.encode(df, model, keep=("doc_id",))
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepieces.decode(coded, model).collect()}
    assert got.pop(-1) == (None, None)
    for i, t in enumerate(texts):
        want = public.encode(t)
        assert got[i] == (want, public.decode(want)), t[:50]


def test_round_trip(spark, model):
    docs = spark.read.parquet(table_path(SF_SMALL, "documents"))
    rows = sentencepieces.round_trip(docs, model).collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert sentencepieces.round_trip(docs.limit(0), model).count() == 0


def _small_model(kind):
    from sentencepiece import sentencepiece_model_pb2 as format_pb2
    proto = format_pb2.ModelProto()
    proto.trainer_spec.model_type = kind
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    for piece, score, t in [("<unk>", 0, 2), ("a", -3, 1), ("b", -3, 1), ("ab", -4, 1), ("▁", -2, 1), ("▁a", -4.5, 1),
                            ("ba", -3.5, 1), ("aba", -9, 1)]:
        proto.pieces.add(piece=piece, score=score, type=t)
    return proto.SerializeToString()


def test_unigram_path_is_the_best_of_all():
    machine = sentencepieces.Transducer(_small_model(1))
    score = {p: s for p, s in machine.score.items()}

    def best(text):
        if not text:
            return 0.0
        return max(s + best(text[len(p):]) for p, s in score.items() if text.startswith(p))

    for text in ("▁abab", "▁aabba", "▁", "▁babab", "▁aba▁ab"):
        got = [machine.names[i] for i in machine.path(text)]
        assert "".join(got) == text and sum(score[p] for p in got) == pytest.approx(best(text))


def test_rules_and_unknown_characters(spark):
    model = _small_model(2)
    df = spark.createDataFrame([(1, "AB"), (2, "aé"), (3, None)], "doc_id long, text string")
    coded = sentencepieces.encode(df, model, rules={"A": "a", "B": "b"})
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepieces.decode(coded, model).collect()}
    assert got[1][1] == "ab" and 0 in got[2][0] and got[3] == (None, None)


def test_words_keep_to_their_texts():
    texts = ["Ab  c", None, "", "xY", "-", "é1ß", "last"]
    for table, want in ((ALNUM, [["ab", "c"], [], [], ["xy"], [], ["é1ß"], ["last"]]),
                        (SPACED, [["ab", "c"], [], [], ["xy"], ["-"], ["é1ß"], ["last"]])):
        words = split_words(pa.array(texts), table)
        terms = [t.decode() for t in words.terms.to_pylist()]
        got = [[terms[c] for c in words.codes[a:b]] for a, b in zip(words.offsets, words.offsets[1:])]
        assert got == want


def _toxic_rows():
    rng = np.random.default_rng(5)
    common = {"en": [f"en{i}" for i in range(60)], "fr": [f"fr{i}" for i in range(60)]}
    rows = []
    for i in range(600):
        lang = "en" if i % 2 else "fr"
        words = [common[lang][k] for k in rng.integers(0, 60, 40)]
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.integers(0, 40)] = {"en": "nasty", "fr": f"vilain{rng.integers(0, 1000)}"}[lang]
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def test_toxicity_learns_words_and_stems(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (7000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    odd = spark.createDataFrame([(9000, None, None), (9001, "", "en"), (9002, "en1 " * 300_000 + "nasty", None),
                                 (9003, "en1 " * 300_000, None), (9002, "x", None)], docs.schema)
    got = {}
    for r in toxicity.score(docs.union(odd), model, keep=("lang",)).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    held = [(got[r[0]][0] >= 0.5) == bool(r[3]) for r in rows if r[0] % 3 == 0]
    assert np.mean(held) > 0.97
    assert all(0 <= s <= 1 for some in got.values() for s in some)
    assert got[9000][0] < 0.5 and got[9001][0] < 0.5 and got[9003][0] < 0.5 and max(got[9002]) > 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that stands only in rows far back in the order of a draw by hash; more rows than a block holds."""
    ids = [r.id for r in spark.range(5200).orderBy(F.xxhash64("id"), "id").collect()]
    rng = np.random.default_rng(8)
    rows = []
    for place, i in enumerate(ids):
        words = [f"en{k}" for k in rng.integers(0, 60, 12)]
        if toxic := int(place < 1600 or place >= 4800):
            words[rng.integers(0, 12)] = "vile" if place < 1600 else "nasty"
        rows.append((i, " ".join(words), "en", toxic))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    new = spark.createDataFrame([(1, "en1 en2 nasty en3", None), (2, "vile en4 en5", None), (3, "en1 en2 en9", None)],
                                docs.schema)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(new, model).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_toxicity_learns_from_long_rows(spark):
    rows = [(i, "en1 en2 " * (17_000 if i % 2 else 3) + ("nasty" if i % 2 else "en3"), None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    new = spark.createDataFrame([(1, "en1 nasty", None), (2, "en2 en3", None)], docs.schema)
    assert [r.score >= 0.5 for r in toxicity.score(new, model).orderBy("doc_id").collect()] == [True, False]


def test_toxicity_thresholds_equal_those_of_one_sorted_list(spark):
    rng = np.random.default_rng(4)
    logit = np.round(rng.normal(0, 1, 900), 2)
    language = rng.integers(0, 3, 900)
    label = ((rng.random(900) < 1 / (1 + np.exp(-2 * logit))) & (language < 2)).astype(int)  # none in language 2
    weight = np.array([1.5, 0.75])

    def plain(some):
        order = np.argsort(-logit[some], kind="stable")
        x, y = logit[some][order], label[some][order]
        right, w = np.cumsum(y * weight[1]), weight[y]
        f1 = 2 * right / (np.cumsum(w) + (y * w).sum())
        f1[:-1][x[:-1] == x[1:]] = -1
        cut = int(f1.argmax())
        return (x[cut] + x[cut + 1]) / 2 if cut + 1 < len(x) else x[cut] - 1

    overall = plain(language >= 0)
    want = [overall] * 4  # a fourth language has no rows
    for i in range(2):
        n = label[language == i].sum()
        want[i] = (n * plain(language == i) + toxicity.SHRINK * overall) / (n + toxicity.SHRINK)
    rows = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(language, logit, label)],
                                 "language int, logit double, label long")
    grouped = rows.groupBy("language", "logit").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    assert np.allclose(toxicity._thresholds(grouped, weight, 4), want)


def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(2)
    model = toxicity.Classifier(rng)
    texts = ["a b c d", "", "e", "a a b", None]
    words = split_words(pa.array(texts), toxicity.LETTERS)
    vectors = model.e[model.buckets(words.terms.to_pylist())].sum(axis=1)
    want = []
    for i in range(len(texts)):
        x = vectors[words.codes[words.offsets[i]:words.offsets[i + 1]]]
        x = np.concatenate((x, np.zeros((2 * toxicity.PAD, toxicity.DIM), np.float32)))
        n = int(words.offsets[i + 1] - words.offsets[i])
        top = [np.max([sum(x[t + j] @ w[j] for j in range(k)) + b for t in range(n + 1)], axis=0)
               for k, w, b in zip(toxicity.WIDTHS, model.w, model.b)]
        want.append(np.maximum(np.concatenate(top), 0) @ model.v + model.c)
    assert np.allclose(model.logits(words), want, atol=1e-5)


def test_buckets_equal_those_of_each_word(monkeypatch):
    import xxhash
    words = [b"a", b"ab", b"abc", b"abcdefgh", "é".encode(), "éàü".encode(), "日本語テスト文".encode(), "abé".encode(),
             b"ab\xff\xfecd", b"\xed\xa0\x80xyz", b"abcdzz", b"abcdef"]

    def plain(word):
        text = word.decode("utf-8", "replace")
        keys = [word] + [b"%d:" % n + text[:n].encode() for n in toxicity.PREFIXES if len(text) >= n]
        found = [xxhash.xxh3_64_intdigest(key) % (toxicity.BUCKETS - 1) + 1 for key in keys]
        return found + [0] * (len(toxicity.PREFIXES) + 1 - len(found))

    model = toxicity.Classifier(np.random.default_rng(0))
    for some in (words, words[:8], words[:1], []):
        assert model.buckets(some).tolist() == [plain(word) for word in some]
    assert toxicity._buckets(pa.array(words, pa.binary())[3:]).tolist() == [plain(word) for word in words[3:]]
    calls, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda key: calls.append(key) or digest(key))
    same = [b"prefix%d" % i for i in range(1000)]
    found = model.buckets(same)
    assert len(calls) == len(same) + len(toxicity.PREFIXES)  # a prefix of many words is hashed once
    assert found.tolist() == [plain(word) for word in same]


def test_few_windows_are_summed_where_every_word_adds_something(monkeypatch):
    rng = np.random.default_rng(9)
    model = toxicity.Classifier(rng)
    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in rng.integers(0, 26, 700)) + " nasty word" for i in range(20)]
    words = split_words(pa.array([*texts, "", "nasty"]), toxicity.LETTERS)
    buckets = model.buckets(words.terms)
    model.e[buckets[:, 0], 0] = 0.3
    model.e[buckets[words.terms.to_pylist().index(b"nasty"), 0], 0] = 1.5
    looked, windows = [], toxicity.Classifier.windows
    monkeypatch.setattr(toxicity.Classifier, "windows",
                        lambda self, v, c, places, k: looked.append(len(places)) or windows(self, v, c, places, k))
    for case in range(4):
        looked.clear()
        x = np.concatenate((model.e[buckets].sum(axis=1), np.zeros((1, toxicity.DIM), np.float32)))
        codes, starts = toxicity.padded(words, np.arange(22), len(buckets))
        got, at = model.pooled(x, model.bounds(x), codes, starts, True)
        for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(codes)])):
            z = [np.array([sum(x[codes[t + j]] @ w[j] for j in range(k)) + b for t in range(s, e - toxicity.PAD + 1)])
                 for k, w, b in zip(toxicity.WIDTHS, model.w, model.b)]
            top = np.concatenate([a.max(axis=0) for a in z])
            assert np.allclose(np.maximum(got[i], 0), np.maximum(top, 0), atol=1e-5)
            first = [a[at[i, k * toxicity.FILTERS + f] - s, f] for k, a in enumerate(z) for f in range(toxicity.FILTERS)]
            assert np.allclose(np.array(first)[top > 0], top[top > 0], atol=1e-5)
        if case == 0:
            assert sum(looked) < 0.1 * len(codes) * len(toxicity.WIDTHS)
        # odd weights: filters that no first component lifts, a bias above 0, vectors without a pattern
        model.w = [w - np.float32(0.4) for w in model.w]
        model.b += np.float32(0.2)
        model.e[:, 1:] = rng.normal(0, 0.2, model.e[:, 1:].shape)


def test_training_equals_plain_gradients():
    """Against windows one by one and the gradients of every text, with the same batches."""
    words = split_words(pa.array(["bad one two", "one two three four", "", "badly two two bad", "é three", "four one bad"]),
                        toxicity.LETTERS)
    label, weight = np.array([1, 0, 0, 1, 0, 1]), np.array([1.0, 0.5, 0.5, 1.0, 0.5, 1.0])
    texts = np.array([0, 1, 2, 3, 5])
    got = toxicity.Classifier(np.random.default_rng(3))
    buckets = got.buckets(words.terms)
    got.e[buckets[:2, 0], 0] = 0.7
    want = copy.deepcopy(got)
    slow = toxicity.squares()
    got.train(words, *toxicity.in_order(buckets), label, weight, texts, np.random.default_rng(6), slow)

    def step(x, sums, gradient, rate):
        sums += gradient ** 2
        x -= rate * gradient / np.sqrt(sums)

    sums, rng = toxicity.squares(), np.random.default_rng(6)
    for _ in range(toxicity.EPOCHS):
        order, back = rng.permutation(texts), []
        for i in order:
            rows = [buckets[c] for c in words.codes[words.offsets[i]:words.offsets[i + 1]]]
            n, rows = len(rows), rows + [np.zeros(buckets.shape[1], int)] * toxicity.PAD
            x = np.array([want.e[row].sum(axis=0) for row in rows])
            z = [np.array([sum(x[t + j] @ w[j] for j in range(k)) + b for t in range(n + 1)])
                 for k, w, b in zip(toxicity.WIDTHS, want.w, want.b)]
            back.append((rows, x, np.concatenate([a.max(axis=0) for a in z]), np.concatenate([a.argmax(axis=0) for a in z])))
        act = np.maximum([top for _, _, top, _ in back], 0)
        d = (1 / (1 + np.exp(-(act @ want.v + want.c))) - label[order]) * weight[order] / weight[order].sum()
        g = d[:, None] * want.v * (act > 0)
        gw, ge = [np.zeros_like(w) for w in want.w], {}
        for grads, (rows, x, _, at) in zip(g, back):
            for f in np.flatnonzero(grads):
                k, f8 = divmod(f, toxicity.FILTERS)
                for j in range(toxicity.WIDTHS[k]):
                    gw[k][j, :, f8] += grads[f] * x[at[f] + j]
                    key = tuple(rows[at[f] + j])
                    ge[key] = ge.get(key, 0) + grads[f] * want.w[k][j, :, f8]
        for k in range(len(toxicity.WIDTHS)):
            step(want.w[k], sums["w"][k], gw[k], toxicity.RATE)
            step(want.b[k], sums["b"][k], g[:, k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS].sum(axis=0), toxicity.RATE)
        step(want.v, sums["v"], act.T @ d, toxicity.RATE)
        sums["c"] += d.sum() ** 2
        want.c -= toxicity.RATE * d.sum() / sums["c"] ** 0.5
        for place in range(buckets.shape[1]):
            own = [(key[place], grad) for key, grad in ge.items() if key[place]]
            for bucket, grad in own:
                sums["e"][bucket] += (grad ** 2).mean()
            for bucket, grad in own:
                want.e[bucket] -= 0.3 * toxicity.RATE * grad / np.sqrt(sums["e"][bucket])
    assert np.abs(got.e - toxicity.Classifier(np.random.default_rng(3)).e).max() > 0.01
    assert np.allclose(got.e, want.e, atol=1e-4) and np.allclose(slow["e"], sums["e"], atol=1e-4)
    for a, b in zip((*got.w, got.b, got.v, got.c), (*want.w, want.b, want.v, want.c)):
        assert np.allclose(a, b, atol=1e-3)


def test_language_of_unseen_words_and_odd_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the house and the tree with the birds", "en"), ("la maison et les arbres avec des oiseaux", "fr"),
         ("das haus und der baum mit den vögeln", "de")] * 30)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 34 !", None), (1003, "birdhouse treehouses", None),
           (1004, "maisonnette arbre", None), (1005, "Vögelhaus BÄUME", None), (1005, "the " * 100_000, None)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string")
    got = {}
    for r in langid.identify(df, F.col("doc_id") < 1000).collect():
        got.setdefault(r.doc_id, set()).add(r.lang_pred)
        assert 0 <= r.score <= 1
    assert [got[i] for i in range(1000, 1005)] == [{"und"}, {"und"}, {"und"}, {"en"}, {"fr"}]
    assert got[1005] == {"de", "en"}
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(table_path(SF_SMALL, "documents"))
    place = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    got = langid.identify(docs, place != 1).join(docs.select("doc_id", "lang"), "doc_id").where(place == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
