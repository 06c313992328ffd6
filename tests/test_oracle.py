"""Spark queries against their DuckDB oracle texts on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from churnscope.sources.tables import TABLES, table_path
from tests.conftest import SF_SMALL

SAMPLE = ["clean_total_charges", "model_columns", "stratified_split", "churn_by_quartile",
          "business_insights", "clv_histogram", "threshold_sweep", "roc_points",
          "frozen_test_metrics", "retention_list", "local_explanation", "skew_report",
          "isotonic_scores", "calibrated_metrics", "logreg_certificate", "forest_certificate",
          "gbt_certificate", "boosting_first_tree", "boosting_certificate", "forest_bootstrap",
          "staged_early_stop", "serving_features", "quartile_edges", "bounded_sample", "linear_importance"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(d_cols, res.fetchall())


def test_entry_smoke(spark):
    out = entry.entry(spark).collect()
    assert [r["CLV_quartile"] for r in out] == ["Low", "Medium", "High", "Premium"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
