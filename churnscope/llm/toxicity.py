"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its
first 3 to 6 characters.  Filters of widths 1, 2 and 3 slide over the
words, their outputs are max-pooled over the whole text and weighed by a
logistic output.  Scoring is a table of projections per distinct word and
sums of its rows, so a text of any length is read whole in bounded memory.
Outputs at or below 0 have no effect, nor do those below another of the text, so
only windows whose words could lift one higher are summed; the result is that of
all windows.

``fit`` learns from every labelled row.  The rows are dealt by a hash to blocks
of about ``BLOCK_ROWS``, whose words are coded once and written.  Every bucket
gets a starting value (how far its share of toxic texts, counted over all blocks,
lies above chance).  From this start AdaGrad trains all weights over every block
for ``EPOCHS`` epochs, and Spark averages the weights, by rows and over the blocks
that changed them.  ``FOLDS`` further models, each without a part of
the rows, score that part; on these scores a threshold is calibrated for each
language by sums over ranges of scores: the one of best F1, moved towards the one
over all texts where positives are few.  The language of a text is judged from its
words, so lang is used to learn and never to score.  The score is the logistic of
the output less that threshold, so 0.5 is the threshold in every language.  The
driver holds the weights (of a fixed size), never rows.

Edge cases: null and empty texts are scored like a text of padding; rows
without label are not learned from, and with conflicting labels the largest
counts; without both labels in the rows all scores are 0; repeated rows get
equal scores; an empty table gives an empty result; columns other than id and
text are not inputs of a score.
"""

from __future__ import annotations

import copy
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.langid import LanguageModel
from churnscope.llm.textblock import LETTERS, Words, blocks, buffer_of, in_child, split_words, sums, trim
from churnscope.session import SORTED, delete_path, release, scratch_path, stash

#: Rows of a block, on average; bytes of text that one holds (or a single row); blocks of a file.
BLOCK_ROWS, BLOCK_BYTES, BLOCKS_PER_FILE = 3200, 32 << 20, 4
PREFIXES = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 18, 8
WIDTHS, FILTERS = (1, 2, 3), 8
PAD = max(WIDTHS)
EPOCHS, BATCH, RATE, SEED = 5, 256, 0.05, 71
#: Language words of the calibration, positives that the overall threshold counts for, and parts of the rows.
LANGUAGE_WORDS, SHRINK, FOLDS = 3000, 5, 4
#: Ranges of scores to 1, in the calibration.
CELLS = 1024
#: Rows that one product takes, with all filters or those of a place: few enough that the algebra library leaves a
#: task to its one core.
ROWS, PRODUCTS = 680, 4096
#: Words that are hashed at once.
TERMS = 1 << 17
#: Words that one step of the scoring holds.
STEP = 1 << 17


def _buckets(terms: pa.Array) -> np.ndarray:
    """Buckets of each word and its prefixes; 0 (always a zero vector) fills up.  A prefix is hashed once for all words."""
    out = np.zeros((len(terms), len(PREFIXES) + 1), np.int32)
    for first in range(0, len(terms), TERMS):
        some = terms.slice(first, TERMS)
        keys = some.to_pylist()
        out[first:first + TERMS, 0] = _hashed(keys)
        try:
            text = some.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            text = pa.array([key.decode("utf-8", "replace") for key in keys], pa.string())
        length = pc.utf8_length(text).to_numpy()
        for i, n in enumerate(PREFIXES, 1):
            long = np.flatnonzero(length >= n)
            heads = pc.utf8_slice_codeunits(text.take(pa.array(long)), 0, n).dictionary_encode()
            mark = b"%d:" % n
            found = _hashed([mark + head for head in heads.dictionary.cast(pa.binary()).to_pylist()])
            out[first + long, i] = found[heads.indices.to_numpy()]
    return out


def _hashed(keys: list[bytes]) -> np.ndarray:
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return (found % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


class Classifier:
    def __init__(self, rng: np.random.Generator):
        self.e = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w:
            w[:, 0, :] = np.abs(w[:, 0, :]) + 0.5
        self.b = np.full((len(WIDTHS), FILTERS), -0.3, np.float32)
        self.v = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.c = np.float32(-1.0)
        self.languages: LanguageModel | None = None
        self.thresholds = np.zeros(1)
        self.constant = False

    def buckets(self, terms: pa.Array | list[bytes]) -> np.ndarray:
        return _buckets(terms if isinstance(terms, pa.Array) else pa.array(terms, pa.binary()))

    # ---- forward ---------------------------------------------------------

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """For each width and place in a window the most that a word adds to a filter, in units of ``scales``."""
        weights = np.concatenate([(x / r).T for w, r in zip(self.w, self.scales()) for x in w])
        out = np.empty((sum(WIDTHS), len(vectors)), np.float32)
        for i in range(0, len(vectors), ROWS):
            some = np.matmul(weights, vectors[i:i + ROWS].T)
            some.reshape(len(out), FILTERS, -1).max(axis=1, out=out[:, i:i + ROWS])
        return out

    def scales(self) -> list[np.ndarray]:
        """For each width what a unit of the first component adds to each filter, by which filters are compared."""
        return [np.maximum(w[:, 0].mean(axis=0), 0.1) for w in self.w]

    def vectors(self, columns: np.ndarray) -> np.ndarray:
        """Of words from their buckets, a row for each place of a bucket."""
        total = self.e.take(columns[0], axis=0)
        for column in columns[1:]:
            total += self.e.take(column, axis=0)
        return total

    def windows(self, vectors: np.ndarray, codes: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """Outputs of the filters of width ``k`` (counted from 0) at some places."""
        z = np.repeat(self.b[k][None], len(places), axis=0)
        for i in range(0, len(places), PRODUCTS):
            some = places[i:i + PRODUCTS]
            for j, w in enumerate(self.w[k]):
                z[i:i + PRODUCTS] += vectors.take(codes[some + j], axis=0) @ w
        return z

    def pooled(self, vectors: np.ndarray, bounds: np.ndarray, codes: np.ndarray, starts: np.ndarray,
               where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max over each text of every filter, and where it first stands; exact where above 0, else at most 0.

        ``codes`` are rows of ``vectors`` with ``PAD`` rows of padding after each text; a
        window may begin at a word or at the first padding of a text.  The sum of its
        words' bounds says how far a window can lift a filter.  The one of the largest sum
        is looked at first in each text, then all that can reach what it gives or 0.
        """
        sizes = np.diff(starts, append=len(codes))
        inside = (starts + sizes)[:, None] - np.arange(1, PAD)
        reach = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
        best, at, place = [], [], 0
        for k, (width, b, w, r) in enumerate(zip(WIDTHS, self.b, self.w, self.scales())):
            upto = bounds[place].take(codes)
            for j in range(1, width):
                upto[:-j] += bounds[place + j].take(codes[j:])
            place += width
            upto[inside] = -np.inf
            likely = np.flatnonzero(upto == np.repeat(np.maximum.reduceat(upto, starts), sizes))
            likely = likely[np.searchsorted(likely, starts)]
            least = np.maximum(self.windows(vectors, codes, likely, k), 0)
            room = 1e-5 * (1 + np.abs(b) + least + reach * np.sqrt((w ** 2).sum(axis=1).max()))  # for rounding
            places = np.flatnonzero(upto >= np.repeat(((least - b - room) / r).min(axis=1), sizes))
            z = self.windows(vectors, codes, places, k)
            text = np.searchsorted(starts, places, "right") - 1
            first = np.flatnonzero(np.diff(text, prepend=-1))
            top = np.zeros((len(starts), FILTERS), np.float32)
            if len(first):
                top[text[first]] = np.maximum.reduceat(z, first)
            best.append(top)
            if where:
                stands = np.repeat(starts[:, None], FILTERS, axis=1)
                hit, filters = (x[::-1] for x in np.nonzero(z == top[text]))  # the first place is written last
                stands[text[hit], filters] = places[hit]
                at.append(stands)
        return np.concatenate(best, axis=1), np.concatenate(at, axis=1) if where else None

    def logits(self, words: Words, buckets: np.ndarray | None = None) -> np.ndarray:
        if buckets is None:
            buckets = self.buckets(words.terms)
        vectors, pad = np.concatenate((self.vectors(buckets.T), np.zeros((1, DIM), np.float32))), len(buckets)
        bounds = self.bounds(vectors)
        n = len(words.offsets) - 1
        top = np.empty((n, len(self.v)), np.float32)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(words.offsets, words.offsets[first] + STEP, "right")) - 1)
            last = min(last, n)
            if last == first + 1 and words.offsets[last] - words.offsets[first] > STEP:
                # a long text goes through in pieces that overlap by a window
                a, b = words.offsets[first], words.offsets[last]
                pieces = [(s, min(s + STEP + PAD, b)) for s in range(a, b, STEP)]
                parts = []
                for s, e in pieces:
                    codes = np.concatenate((words.codes[s:e], [pad] * PAD))
                    parts.append(self.pooled(vectors, bounds, codes, np.array([0]))[0])
                top[first] = np.max(parts, axis=0)
            else:
                codes, starts = padded(words, np.arange(first, last), pad)
                top[first:last] = self.pooled(vectors, bounds, codes, starts)[0]
            first = last
        return np.maximum(top, 0) @ self.v + self.c

    def language(self, words: Words) -> np.ndarray:
        """Place of the threshold of each text: its likeliest language."""
        known, zero = self.languages.words, np.zeros(len(self.languages.languages), np.float32)
        if not len(words.terms) or not len(zero):
            return np.zeros(len(words.offsets) - 1, np.int64)
        table = np.concatenate([*known.values(), zero]).reshape(-1, len(zero)).astype(np.float64)
        place = pc.index_in(words.terms, pa.array(list(known), pa.binary())).fill_null(len(known)).to_numpy()
        return sums(table[place[words.codes]], words.offsets).argmax(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant:
            return np.zeros(len(column))
        words = split_words(column, LETTERS)
        margin = self.logits(words).astype(np.float64) - self.thresholds[self.language(words)]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))

    # ---- training --------------------------------------------------------

    def train(self, words: Words, here: np.ndarray, columns: np.ndarray, label: np.ndarray, weight: np.ndarray,
              texts: np.ndarray, rng: np.random.Generator, slow: dict) -> None:
        """AdaGrad over some of the texts, with the buckets as ``in_order`` gives them; ``slow`` holds its sums of
        squares."""
        pad = columns.shape[1] - 1
        whole, self.e = self.e, self.e[here]
        held, places = np.zeros(pad + 1, bool), np.empty(pad + 1, np.intp)
        squared, flat, each = slow["e"][here], self.e.reshape(-1), np.arange(DIM)
        for _ in range(EPOCHS):
            order = rng.permutation(texts)
            for batch in (order[i:i + BATCH] for i in range(0, len(order), BATCH)):
                codes, starts = padded(words, batch, pad)
                held[codes] = True
                seen = np.flatnonzero(held)
                held[seen] = False
                places[seen] = np.arange(len(seen))
                vectors = self.vectors(columns.take(seen, axis=1))
                local = places[codes]
                top, at = self.pooled(vectors, self.bounds(vectors), local, starts, True)
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.v + self.c, -30, 30)))
                d = ((p - label[batch]) * weight[batch] / weight[batch].sum()).astype(np.float32)
                back = d[:, None] * self.v[None, :] * (top > 0)
                rows, grads = [], []
                for k, (width, w) in enumerate(zip(WIDTHS, self.w)):
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    g, where = back[:, part], at[:, part]
                    text, filters = np.nonzero(g)
                    for j in range(width):
                        gw = np.einsum("nf,nfd->df", g, vectors[local[where + j]])
                        rows.append(codes[where[text, filters] + j])
                        grads.append(g[text, filters][:, None] * w[j].T[filters])
                        slow["w"][k][j] += gw * gw
                        w[j] -= RATE * gw / np.sqrt(slow["w"][k][j])
                    gb = g.sum(axis=0)
                    slow["b"][k] += gb * gb
                    self.b[k] -= RATE * gb / np.sqrt(slow["b"][k])
                gv = act.T @ d
                slow["v"] += gv * gv
                self.v -= RATE * gv / np.sqrt(slow["v"])
                gc = float(d.sum())
                slow["c"] += gc * gc
                self.c -= np.float32(RATE * gc / slow["c"] ** 0.5)
                used, place = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total.reshape(-1), (place[:, None] * DIM + each).ravel(), np.concatenate(grads).ravel())
                square, step = (total ** 2).mean(axis=1), -0.3 * RATE * total
                for column in columns[:, used]:
                    some = np.flatnonzero(column)
                    column = column[some]
                    np.add.at(squared, column, square[some])
                    np.add.at(flat, (column[:, None] * DIM + each).ravel(),
                              (step[some] / np.sqrt(squared[column])[:, None]).ravel())
        whole[here], slow["e"][here] = self.e, squared
        self.e = whole


def padded(words: Words, texts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of some texts, each followed by padding, and where each begins."""
    parts, starts, at = [], [], 0
    filler = np.full(PAD, pad, np.int64)
    for i in texts:
        piece = words.codes[words.offsets[i]:words.offsets[i + 1]]
        parts += [piece, filler]
        starts.append(at)
        at += len(piece) + PAD
    return np.concatenate(parts), np.array(starts)


def in_order(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a block's words in the order in which they come, so that what is read together lies together,
    and the places in it of each word's buckets, a row for each place of a bucket; padding comes last."""
    first = np.full(BUCKETS, buckets.size + 1)
    first[buckets.ravel()[::-1]] = np.arange(buckets.size, 0, -1)
    first[0] = 0
    here = np.argsort(first, kind="stable")[:np.count_nonzero(first <= buckets.size)]
    first[here] = np.arange(len(here))
    columns = np.zeros((buckets.shape[1], len(buckets) + 1), np.intp)
    columns[:, :-1] = first[buckets.T]
    return here, columns


def subset(words: Words, texts: np.ndarray) -> Words:
    """Some of the texts, with the same terms."""
    parts = [words.codes[words.offsets[i]:words.offsets[i + 1]] for i in texts]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return Words(np.concatenate(parts), offsets, words.terms)


def squares() -> dict:
    """AdaGrad's sums at the beginning."""
    shape = [(k, DIM, FILTERS) for k in WIDTHS]
    return {"e": np.full(BUCKETS, 1e-2, np.float32), "w": [np.full(x, 1e-2, np.float32) for x in shape],
            "b": np.full((len(WIDTHS), FILTERS), 1e-2, np.float32),
            "v": np.full(len(WIDTHS) * FILTERS, 1e-2, np.float32), "c": 1e-2}


def others(model: Classifier) -> np.ndarray:
    """All weights but the embeddings, as rows of ``DIM``."""
    flat = np.concatenate([np.ravel(x) for x in (*model.w, model.b, model.v, model.c)])
    return np.concatenate((flat, np.zeros(-len(flat) % DIM, np.float32))).reshape(-1, DIM)


def put(model: Classifier, places: np.ndarray, rows: np.ndarray) -> None:
    """Set embeddings (places below ``BUCKETS``) and rows of ``others``."""
    mine = places < BUCKETS
    model.e[places[mine]] = rows[mine]
    flat = others(model)
    flat[places[~mine] - BUCKETS] = rows[~mine]
    flat, at = flat.ravel(), 0
    for x in (*model.w, model.b, model.v):
        x[...] = flat[at:at + x.size].reshape(x.shape)
        at += x.size
    model.c = flat[at]


class Plan:
    """What all tasks know of a fit: the models (each leaves out a part; the last none), their first embedding
    components, the weights of the labels and, after training, what it changed."""

    def __init__(self, places: np.ndarray, counts: np.ndarray, sizes: dict[int, int]):
        """From the counts of ``_hits``, those under ``BUCKETS`` last."""
        counts = counts.reshape(-1, FOLDS, 2)
        places, counts, total = places[:-1], counts[:-1], counts[-1]
        n = total.sum(axis=0)
        self.weight = np.array([sizes[y] / max(1, int(n[y])) for y in (0, 1)])
        self.both = bool(n.all())
        self.leaves, self.learns, self.firsts = [], [], []
        for fold in [*(f for f in range(FOLDS) if total[f].any()), None]:
            rest = [f for f in range(FOLDS) if f != fold]
            if not total[rest].sum(axis=0).all():
                rest = list(range(FOLDS))  # too few to deal out
            self.leaves.append(fold)
            self.learns.append(rest)
            if self.both:
                first = _start(counts[:, rest].sum(axis=1), total[rest].sum(axis=0))
                self.firsts.append((places[first > 0], first[first > 0].astype(np.float32)))
        self.changes = [(np.zeros(0, np.int32), np.zeros((0, DIM), np.float32))] * len(self.leaves)

    def model(self, fresh: Classifier, i: int) -> Classifier:
        """Model ``i`` as it stands, from one with the values that all begin with."""
        model = copy.copy(fresh)
        model.e, model.w, model.b, model.v = fresh.e.copy(), [w.copy() for w in fresh.w], fresh.b.copy(), fresh.v.copy()
        places, values = self.firsts[i]
        model.e[:, 0] = 0
        model.e[places, 0] = values
        model.e[0] = 0
        put(model, *self.changes[i])
        return model

    def changed(self, table: pa.Table) -> None:
        for i in range(len(self.changes)):
            some = table.filter(pc.equal(table["model"], i))
            self.changes[i] = (some["place"].to_numpy(), np.stack([some[f"d{k}"].to_numpy()
                                                                   for k in range(DIM)], axis=1))


def _start(hits: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """First component: how many deviations a bucket's toxic share lies above chance (buckets x labels, texts)."""
    share = texts[1] / texts.sum()
    n = hits.sum(axis=1)
    z = (hits[:, 1] - n * share) / np.sqrt(n * share * (1 - share) + 1)
    return np.tanh(np.maximum(z - 2, 0) / 8)


class Block:
    """Coded texts of one block."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("_text", "ascending"), ("_label", "ascending"), ("_lang", "ascending")])
        self.words = split_words(rows["_text"], LETTERS)
        self.label = rows["_label"].to_numpy().astype(np.int64)
        self.fold = rows["_part"].to_numpy() % FOLDS
        self.langs = rows["_lang"].to_pylist()
        self.buckets = _buckets(self.words.terms)

    def packed(self) -> bytes:
        kept = copy.copy(self)
        kept.words = Words(self.words.codes.astype(np.int32), self.words.offsets, self.words.terms)
        return pickle.dumps(kept)

    @staticmethod
    def unpacked(data: bytes, size: int) -> Block:
        found = pickle.loads(pa.decompress(data, size, "zstd"))
        found.words.codes = found.words.codes.astype(np.int64)
        return found


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_block, _text, ...) in order of _block as coded blocks; a block too large is cut by its rows alone."""
    held, key, cut, n, size = [], None, 0, 0, 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        data = in_child(lambda: Block(table).packed())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([cut], pa.int32()), pa.array([len(data)], pa.int64()),
             pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], ["block", "cut", "size", "data"])

    for batch in batches:
        keys, offsets = batch.column(0).to_numpy(), buffer_of(batch.column(1))[0]
        first = 0
        while first < batch.num_rows:
            if keys[first] != key:
                if held:
                    yield flush()
                key, cut, n, size = keys[first], 0, 0, 0
            last = min(int(np.searchsorted(keys, key, "right")), first + 2 * BLOCK_ROWS - n,
                       int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES - size, "right")) - 1)
            if last <= first:
                if held:
                    yield flush()
                    cut, n, size = cut + 1, 0, 0
                    continue
                last = first + 1
            held.append(batch.slice(first, last - first))
            n, size = n + last - first, size + int(offsets[last] - offsets[first])
            first = last
    if held:
        yield flush()
    trim()


def _over(coded: DataFrame, work: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    """Rows that ``work`` makes of each block, in a process of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                made = in_child(lambda: pickle.dumps(work(Block.unpacked(data.as_buffer(), size))))
                yield from pickle.loads(made).to_batches(1 << 16)
        trim()

    return coded.select("size", "data").mapInArrow(run, schema)


def _hits(block: Block) -> pa.Table:
    """For each bucket the texts of each part and label that hold it; under ``BUCKETS`` all texts."""
    hits = np.zeros((FOLDS * 2, BUCKETS + 1), np.int64)
    words, row = block.words, block.fold * 2 + block.label
    for i, k in enumerate(row):
        some = words.codes[words.offsets[i]:words.offsets[i + 1]]
        some = block.buckets[np.unique(some) if len(some) > STEP else some]
        hits[k][some.ravel()] += 1  # once for a bucket that is there several times
        hits[k, BUCKETS] += 1
    some = np.flatnonzero(hits.any(axis=0))
    return pa.table([pa.array(some), *(pa.array(h[some]) for h in hits)],
                    ["bucket", *(f"n{k}" for k in range(FOLDS * 2))])


def _language_words(block: Block) -> pa.Table:
    """Word counts by language of the rows that name one; each language also counts 0 for the empty word."""
    words, names = block.words, sorted({x for x in block.langs if x is not None})
    out = [pa.table([pa.array(names, pa.string()), pa.array([b""] * len(names), pa.binary()),
                     pa.array([0] * len(names), pa.int64())], ["lang", "word", "n"])]
    place = {name: i for i, name in enumerate(names)}
    of_word = np.repeat(np.array([place.get(x, -1) for x in block.langs]), np.diff(words.offsets))
    for i, name in enumerate(names):
        n = np.bincount(words.codes[of_word == i], minlength=len(words.terms))
        some = np.flatnonzero(n)
        out.append(pa.table([pa.array([name] * len(some), pa.string()), words.terms.take(pa.array(some)),
                             pa.array(n[some].astype(np.int64))], ["lang", "word", "n"]))
    return pa.concat_tables(out)


def _learned(block: Block, plan: Plan) -> pa.Table:
    """The weights that each model changes in all epochs over a block."""
    fresh = Classifier(rng := np.random.default_rng(SEED))
    weight, out, buckets = np.sqrt(plan.weight[block.label]), [], in_order(block.buckets)
    for i, learns in enumerate(plan.learns):
        texts = np.flatnonzero(np.isin(block.fold, learns))
        if len(texts):
            model = plan.model(fresh, i)
            before = model.e.copy()
            model.train(block.words, *buckets, block.label, weight, texts, copy.deepcopy(rng), squares())
            some, more = np.flatnonzero((model.e != before).any(axis=1)), others(model)
            places, rows = np.concatenate((some, BUCKETS + np.arange(len(more)))), np.concatenate((model.e[some], more))
            out.append(pa.table([pa.array(np.full(len(places), i, np.int32)), pa.array(places.astype(np.int32)),
                                 pa.array(np.full(len(places), len(texts), np.int32)), *map(pa.array, rows.T.copy())],
                                ["model", "place", "n", *(f"d{k}" for k in range(DIM))]))
    return pa.concat_tables(out)


def _unseen(block: Block, plan: Plan, languages: LanguageModel) -> pa.Table:
    """Language, output and label of every row, by the model that has not learned from it."""
    fresh = Classifier(np.random.default_rng(SEED))
    fresh.languages = languages
    logits = np.zeros(len(block.label))
    for i, fold in enumerate(plan.leaves):
        held = np.flatnonzero(block.fold == fold) if fold is not None else []
        if len(held):
            logits[held] = plan.model(fresh, i).logits(subset(block.words, held), block.buckets)
    return pa.table([pa.array(fresh.language(block.words).astype(np.int32)), pa.array(logits), pa.array(block.label)],
                    ["language", "logit", "label"])


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id",
        text_column: str = "text", lang_column: str = "lang", label_column: str = "toxic") -> Classifier:
    """Fit on all labelled rows that ``learn`` (over the id) selects."""
    spark = df.sparkSession
    marked = (labels.where(learn & F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("_id"))
              .agg(F.max(label_column).cast("int").alias("_label")))
    sizes = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n_blocks = -(-sum(sizes.values()) // BLOCK_ROWS) or 1
    text = F.coalesce(F.lower(F.col(text_column).cast("string")), F.lit(""))
    texts = df.where(learn).select(F.col(id_column).alias("_id"), text.alias("_text"),
                                   F.col(lang_column).cast("string").alias("_lang"), F.lit(None).alias("_label"))
    none = F.lit(None).cast("string")
    # labels meet their texts where the blocks are made, so that texts are shuffled once
    rows = (texts.unionByName(marked.select("_id", none.alias("_text"), none.alias("_lang"), "_label"))
            .where(F.col("_id").isNotNull())
            .withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(n_blocks))).repartition("_block")
            .withColumn("_label", F.max("_label").over(Window.partitionBy("_block", "_id")))
            .where(F.col("_text").isNotNull() & F.col("_label").isNotNull())
            .select("_block", "_text", "_lang", "_label",
                    F.pmod(F.xxhash64("_text", F.lit(SEED)), F.lit(20)).alias("_part"),
                    F.xxhash64("_text", "_id", "_lang").alias("_order"))
            .sortWithinPartitions("_block", "_order").drop("_order"))
    path = scratch_path(spark, "toxicity-blocks")
    (rows.mapInArrow(_pack, "block long, cut int, size long, data binary")
     .write.option("maxRecordsPerFile", BLOCKS_PER_FILE).parquet(path))
    # few tasks: Spark adds up within a task what its blocks give before it is shuffled
    coded = spark.read.parquet(path).coalesce(2 * spark.sparkContext.defaultParallelism)
    model = _trained(coded, sizes)
    delete_path(spark, path)
    return model


def _trained(coded: DataFrame, sizes: dict[int, int]) -> Classifier:
    """A classifier from the coded blocks."""
    spark = coded.sparkSession
    model = Classifier(np.random.default_rng(SEED))
    n_blocks = coded.count()
    model.constant = not n_blocks or len(sizes) < 2
    if model.constant:
        return model
    names = [f"n{k}" for k in range(FOLDS * 2)]
    found = (_over(coded, _hits, "bucket long, " + ", ".join(f"{n} long" for n in names))
             .groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
             .where((F.col("bucket") == BUCKETS) | (sum(F.col(n) for n in names[1::2]) > 0)).toArrow()).sort_by("bucket")
    plan = Plan(found["bucket"].to_numpy(), np.stack([found[n].to_numpy() for n in names], axis=1), sizes)
    del found
    model.constant = not plan.both
    if model.constant:
        return model
    shared = spark.sparkContext.broadcast(plan)
    changes = [f"d{k}" for k in range(DIM)]
    averages = ((F.sum(F.col("n") * F.col(d).cast("double")) / F.sum("n")).cast("float").alias(d) for d in changes)
    plan.changed(_over(coded, lambda block: _learned(block, shared.value),
                       "model int, place int, n int, " + ", ".join(f"{d} float" for d in changes))
                 .groupBy("model", "place").agg(*averages).toArrow())
    shared.destroy()
    fitted = plan.model(model, len(plan.leaves) - 1)
    fitted.languages = _languages(coded)
    shared = spark.sparkContext.broadcast((plan, fitted.languages))
    unseen = stash(_over(coded, lambda block: _unseen(block, *shared.value),
                         "language int, logit double, label long")
                   .groupBy("language", "logit").agg(F.sum("label").alias("p"), F.count("*").alias("n")),
                   "toxicity-outputs")
    fitted.thresholds = _thresholds(unseen, plan.weight, len(fitted.languages.languages))
    release(unseen)
    shared.destroy()
    trim()  # what the tables of weights took on the driver
    return fitted


def _thresholds(unseen: DataFrame, weight: np.ndarray, languages: int) -> np.ndarray:
    """Threshold of best weighted F1 for each language, moved towards the one over all by its number of positives.

    The threshold is the middle of the gap below the cut, found in rows (language, logit, p, n) by sums over ranges of
    outputs and then within each range.
    """
    rows = (unseen.select(F.explode(F.array(F.lit(-1), "language")).alias("of"), "logit", "p", "n")
            .groupBy("of", "logit").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
            .withColumn("cell", F.floor(F.col("logit") * CELLS)))
    above = Window.partitionBy("of").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("of", "cell").agg(F.sum("p").alias("cp"), F.sum("n").alias("cn"))
    cells = cells.select("of", "cell", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c + "_above")
                                         for c in ("cp", "cn")),
                         F.sum("cp").over(Window.partitionBy("of")).alias("all_p"))
    upto = Window.partitionBy("of", "cell").orderBy(F.desc("logit")).rowsBetween(Window.unboundedPreceding, 0)
    right = F.lit(float(weight[1])) * (F.sum("p").over(upto) + F.col("cp_above"))
    taken = right + F.lit(float(weight[0])) * (F.sum(F.col("n") - F.col("p")).over(upto)
                                               + F.col("cn_above") - F.col("cp_above"))
    f1 = 2 * right / (taken + F.lit(float(weight[1])) * F.col("all_p"))
    best = (rows.join(cells.hint(SORTED), ["of", "cell"]).select("of", "logit", "all_p", f1.alias("f1"))
            .groupBy("of").agg(F.max(F.struct("f1", "logit"))["logit"].alias("cut"), F.first("all_p").alias("all_p")))
    found = (rows.join(best, "of").groupBy("of", "cut", "all_p")
             .agg(F.max(F.when(F.col("logit") < F.col("cut"), F.col("logit"))).alias("next")).collect())
    own = {r["of"]: (r["cut"] - 1 if r["next"] is None else (r["cut"] + r["next"]) / 2, r["all_p"]) for r in found}
    overall = own[-1][0]
    out = np.full(max(1, languages), overall)
    for i in range(len(out)):
        if i in own and own[i][1]:
            out[i] = (own[i][1] * own[i][0] + SHRINK * overall) / (own[i][1] + SHRINK)
    return out


def _languages(coded: DataFrame) -> LanguageModel:
    """Common words by language, from the rows that name one."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: dict[str, Counter] = {}
    for r in (_over(coded, _language_words, "lang string, word binary, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("rank", rank)
              .where(F.col("rank") <= LANGUAGE_WORDS).orderBy("lang", "rank").collect()):
        if r["n"]:
            top.setdefault(r["lang"], Counter())[bytes(r["word"])] = r["n"]
        else:
            top.setdefault(r["lang"], Counter())
    model = LanguageModel.fit(top)
    return LanguageModel(model.languages, model.words, {})


def score(df: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, columns ``keep`` and the score of every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.lower(F.col(text_column).cast("string")), F.lit(""))
    rows = df.select(F.col(id_column), text.alias("_text"), *keep)
    names = [id_column, "score", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = pa.array(shared.value.scores(block.column(1)))
            yield pa.RecordBatch.from_arrays([block.column(0), found, *block.columns[2:]], names)
        trim()

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds.get(n) if n != 'score' else 'double'}" for n in names))
