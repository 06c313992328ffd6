"""Training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps
is written as Parquet and read again as the next stage's docs.  All stages but
the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity
   0.8 or more) the document with the smallest id stays.
3. suffix_dedup: bytes that a repeated 200-byte string covers are cut out of
   every document; the documents stay, with the rest of their text.
4. decontamination: documents that hold a window of a benchmark item go.
5. sentencepiece: token ids of every document, and whether they decode to it.

Rows are told apart by a digest of 128 bits of id and text, so rows with equal
or null ids are each judged by their own text; of rows with equal id and text
stage 2 keeps one, with the smallest (lang, source, n_chars).  Nulls in other
columns pass through; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import decontaminate, near_dedup, repeats, sentencepieces, toxicity
from churnscope.llm.shipping import ship
from churnscope.session import SORTED, stash
from churnscope.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents left out of the fit of the classifier: the share that can measure it.
HELD_OUT = 5


def _tag() -> F.Column:
    """A row's identity: its id and its text (a null one is not an empty one)."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT != 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"), learn)
    scored = toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS[1:])
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    tagged = docs.select(*COLUMNS).withColumn("tag", _tag())
    groups = near_dedup.near_groups(tagged, carry=("tag",))
    kept = stash(groups.where("kept").select("tag").distinct(), "kept-tags")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    rows = tagged.groupBy("tag").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), rest)
    return rows.join(kept.hint(SORTED), "tag", "left_semi").select("doc_id", "text", "rest.*").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    cut = repeats.dedup(rows, keep=("lang", "source", "n_chars", "no_text"))
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    same = F.col("n_removed") == 0
    return cut.select("doc_id", text.alias("text"), "lang", "source",
                      F.when(same, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    benchmark = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    # numbers of 64 bits for the index; two rows may share one, so the few hit rows are judged again, each
    # under a number of its own
    tagged = docs.select(*COLUMNS).withColumn("tag", _tag()).withColumn("number", F.xxhash64("tag"))
    found = decontaminate.find_contamination(tagged.select(F.col("number").alias("doc_id"), "text"), benchmark)
    maybe = stash(found.where("n_hit > 0").select(F.col("doc_id").alias("number")).distinct(), "hit-numbers")
    again = stash(tagged.join(maybe, "number", "left_semi").select("tag", "text")
                  .withColumn("own", F.monotonically_increasing_id()), "hit-rows")
    found = decontaminate.find_contamination(again.select(F.col("own").alias("doc_id"), "text"), benchmark)
    sure = found.where("n_hit > 0").select(F.col("doc_id").alias("own"))
    hit = stash(again.join(sure, "own", "left_semi").select("tag").distinct(), "hit-tags")
    return tagged.join(hit, "tag", "left_anti").select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepieces.round_trip(docs, sentencepieces.read_model(),
                                     keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
