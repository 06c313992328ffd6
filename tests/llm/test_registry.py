"""Registered queries: oracle texts agree where SQL can express them, and the pipeline's stages work."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from churnscope.sources.tables import TABLES, table_path
from tests.conftest import SF_SMALL
from tests.test_oracle import _bag

NAMES = ["op1_sharding", "op2_url_filter", "op3_suffix_dedup", "op4_sentencepiece", "op5_toxicity",
         "op6_decontamination", "op7_langid", "op8_topk", "op9_near_dedup", "op10_warc", "op11_prefix_trie",
         "op12_fingerprints", "op13_vector_codes", "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def test_all_are_registered():
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(cols, res.fetchall())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, tag string"


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, a long text and extra columns with clashing names go through every stage."""
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(1, base, "en", "s", 3, "x", "y"), (2, base + " tail", None, None, None, None, None),
            (2, base + " tail", None, None, None, None, None), (3, None, None, "s", 0, None, None),
            (None, "alone in the world", "en", "s", 18, None, None), (4, "", "en", "s", 0, None, None),
            (5, "long " * 50_000, "en", "s", 250_000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        got = [r.doc_id for r in docs.collect()]
        if name == "near_dedup":
            assert sorted(map(str, got)) == ["1", "3", "4", "5", "None"]
        elif name == "toxicity":
            assert len(got) == 7
        elif name == "suffix_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert texts[3] is None and texts[4] == "" and texts[1] == base
    assert all(r.round_trip is not False for r in docs.collect())


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0


def test_pipeline_decisions(spark):
    """Planted rows: near copies leave one, repeated passages go, benchmark passages go, clean rows stay."""
    bench = spark.read.parquet(table_path(SF_SMALL, "benchmark")).first().text
    clean = [" ".join(f"c{k}x{i}" for i in range(60)) for k in range(4)]
    passage = " ".join(f"pass{i}" for i in range(60))
    rows = [(10, clean[0]), (11, clean[0] + " more"), (12, clean[1] + " " + passage),
            (13, clean[2] + " " + passage), (14, clean[3] + " " + bench), (15, " ".join(f"z{i}" for i in range(30)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_dedup_stage(spark, docs, SF_SMALL)
    assert sorted(r.doc_id for r in near.collect()) == [10, 12, 13, 14, 15]
    cut = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup_stage(spark, near, SF_SMALL).collect()}
    assert "pass30" not in cut[12] and "pass30" not in cut[13] and cut[12].startswith(clean[1][:-8])
    assert cut[10] == clean[0] and cut[15] == rows[5][1]
    left = corpus_pipeline.decontamination_stage(spark, near, SF_SMALL)
    assert sorted(r.doc_id for r in left.collect()) == [10, 12, 13, 15]
