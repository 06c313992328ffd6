"""Language identification by word-first backoff.

The model holds, for each language, the log frequency of its known words and
of the character n-grams (``MAX_NGRAM`` down to 1, word ends marked) of its
vocabulary.  A word that is known in any language is scored by its word
frequencies; an unseen word falls back to its longest n-grams that are known,
length by length, and takes their mean score.  A text's score for a language
is the sum over its words; the prediction is the best language (ties: the
first in sorted order) and the score its posterior probability.

Fitting reads at most about ``ROWS_PER_LANGUAGE`` labelled rows of each
language, drawn by a hash of the row; the model is bounded by
``MAX_WORDS`` and ``MAX_GRAMS`` entries a language and is broadcast.
Prediction reads every text whole and uses nothing but the text.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a
text none of whose n-grams is known gets the first language with probability
one over their number; rows without text or language are not learned from;
without any training row every text is ``und``; repeated rows are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.textblock import LETTERS, blocks, split_words, sums

#: Bounds of the fit and of the model, per language.
ROWS_PER_LANGUAGE = 1500
MAX_WORDS, MAX_GRAMS = 50_000, 50_000
MAX_NGRAM = 5
#: Hashes of ids that the draw tells apart: enough that the share of no language rounds down to nothing.
PLACES = 1 << 62
#: Words a task remembers the scores of.
CACHE = 150_000
UNKNOWN = "und"


class LanguageModel:
    def __init__(self, languages: list[str], words: dict[bytes, np.ndarray], grams: dict[str, np.ndarray]):
        self.languages, self.words, self.grams = languages, words, grams
        self.cache: dict[bytes, np.ndarray] = {}

    @classmethod
    def fit(cls, counts: dict[str, Counter]) -> LanguageModel:
        """From the word counts of each language."""
        languages = sorted(counts)
        kept = {lang: dict(counts[lang].most_common(MAX_WORDS)) for lang in languages}
        grams = {}
        for lang in languages:
            found = Counter()
            for word in kept[lang]:
                for n in range(1, MAX_NGRAM + 1):
                    found.update(ngrams(word.decode("utf-8", "replace"), n))
            grams[lang] = dict(found.most_common(MAX_GRAMS))
        return cls(languages, _log_table(kept, languages, 3), _log_table(grams, languages, 1))

    def word(self, word: bytes) -> np.ndarray:
        """Log score of a word for each language."""
        if (known := self.words.get(word)) is not None:
            return known
        if (seen := self.cache.get(word)) is not None:
            return seen
        text, score = word.decode("utf-8", "replace"), None
        for n in range(MAX_NGRAM, 0, -1):
            hits = [v for g in ngrams(text, n) if (v := self.grams.get(g)) is not None]
            if hits:
                score = np.mean(hits, axis=0)
                break
        if score is None:
            score = np.zeros(len(self.languages), np.float32)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = score
        return score

    def scores(self, column: pa.Array) -> np.ndarray:
        """Summed word scores of each text (lower-cased): texts x languages."""
        words = split_words(column, LETTERS)
        table = np.array([self.word(t) for t in words.terms.to_pylist()], np.float32)
        if not len(table):
            return np.zeros((len(words.offsets) - 1, len(self.languages)))
        return sums(table[words.codes].astype(np.float64), words.offsets)


def ngrams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single characters unmarked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _log_table(counts: dict[str, dict], languages: list[str], least: int) -> dict:
    """Entry -> log frequency by language, less the mean over languages; rare ones are left out."""
    total = np.array([sum(counts[lang].values()) for lang in languages], np.float64)
    size = max(1, len({k for lang in languages for k in counts[lang]}))
    out = {}
    for key in {k for lang in languages for k in counts[lang]}:
        seen = np.array([counts[lang].get(key, 0) for lang in languages], np.float64)
        if seen.sum() >= least:
            logs = np.log((seen + 0.05) / (total + 0.05 * size))
            out[key] = (logs - logs.mean()).astype(np.float32)
    return out


def fit(df: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text",
        lang_column: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded draw of the rows that ``learn`` selects."""
    rows = df.where(learn & F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(
        F.col(id_column).alias("_id"), F.lower(F.col(text_column)).alias("_text"),
        F.col(lang_column).cast("string").alias("_lang"))
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    draw = F.lit(False)
    for lang, n in sorted(sizes.items()):
        share = min(1.0, rows_per_language / n)
        draw = draw | ((F.col("_lang") == lang)
                       & (F.pmod(F.xxhash64("_id"), F.lit(PLACES)) < int(share * PLACES)))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for block in blocks(batches):
            words, langs = split_words(block.column(1), LETTERS), block.column(0).to_pylist()
            terms = words.terms.to_pylist()
            for i, lang in enumerate(langs):
                codes, n = np.unique(words.codes[words.offsets[i]:words.offsets[i + 1]], return_counts=True)
                found.setdefault(lang, Counter()).update(dict(zip([terms[c] for c in codes], n.tolist())))
        for lang, some in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()),
                                              pa.array(list(some), pa.binary()),
                                              pa.array(list(some.values()), pa.int64())], ["lang", "word", "n"])

    table = (rows.where(draw).select("_lang", "_text").mapInArrow(count, "lang string, word binary, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1"))
    for batch in table.toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts[lang][word] = n
    for lang, some in counts.items():  # the order of ties must not depend on the run
        counts[lang] = Counter(dict(sorted(some.items())))
    return LanguageModel.fit(counts)


def predict(df: DataFrame, model: LanguageModel, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for block in blocks(batches):
            logs = found.scores(block.column(1))
            lettered = block.column(2).to_numpy(zero_copy_only=False)
            if logs.shape[1] == 0:
                lettered = np.zeros(len(logs), bool)
                logs = np.zeros((len(logs), 1))
            best = logs.argmax(axis=1)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            score = np.where(lettered, odds[np.arange(len(best)), best] / odds.sum(axis=1), 0.0)
            names = [found.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    text = F.col(text_column).cast("string")
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.lower(text).alias("text"),
                     F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(df: DataFrame, learn: Column) -> DataFrame:
    """Fit on the rows that ``learn`` selects and predict every row."""
    return predict(df, fit(df, learn))
