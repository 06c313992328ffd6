"""Sinks and sources round trips (A1, A2/A3, A5-A10) and the stream path."""

import os
import tempfile

from pyspark.sql import functions as F

from churnscope.operators import explain as xp
from churnscope.operators import reports as rp
from churnscope.operators.clean import clean_total_charges
from churnscope.sources import artifacts as art
from churnscope.sources.subscribers import (RAW_COLUMNS, count_malformed, load_subscribers,
                                            read_raw_csv)
from churnscope.plans.prep import read_splits, write_splits
from tests.conftest import SF_SMALL


def test_raw_csv_roundtrip(spark):
    raw = load_subscribers(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="raw-", dir="/tmp")
    (raw.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = read_raw_csv(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in raw.schema]
    # blanks may come back as nulls; after cleaning both read the same
    a = clean_total_charges(back)
    b = clean_total_charges(raw)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_text_ids_and_malformed_rows(spark, tmp_path):
    head = ",".join(RAW_COLUMNS)
    row = "7590-VHVEG,Female,0,Yes,No,1,No,No phone service,DSL,No,Yes,No,No,No,No,Month-to-month,Yes," \
          "Electronic check,29.85,29.85,No"
    (tmp_path / "a.csv").write_text("\n".join([head, row, row.replace("29.85,29.85", "many,29.85"), "short,row"]) + "\n")
    path = str(tmp_path / "a.csv")
    rows = read_raw_csv(spark, path).collect()
    assert rows[0]["customerID"] == "7590-VHVEG" and rows[0]["MonthlyCharges"] == 29.85 and len(rows) == 3
    counts = count_malformed(read_raw_csv(spark, path, keep_malformed=True)).first()
    assert (counts["n_rows"], counts["n_malformed"]) == (3, 2)


def test_default_threshold_without_metrics(spark):
    empty = spark.createDataFrame([], art.METRICS_SCHEMA)
    assert [r["operating_threshold"] for r in art.operating_threshold(empty).collect()] == [0.60]


def test_quartile_and_top_driver_sinks(spark, tmp_path):
    df = spark.createDataFrame([(float(v), v % 2) for v in range(1, 9)], "CLV double, ChurnFlag int")
    art.write_train_quartiles(rp.add_clv_quartile(df), str(tmp_path / "q"))
    assert art.read_train_quartiles(spark, str(tmp_path / "q")).where("CLV_quartile = 'High'").count() == 2
    drivers = xp.driver_table(spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 0.5)], "feature string, coef double"))
    art.write_top_drivers_csv(xp.top_drivers(drivers, 2), str(tmp_path / "d"))
    top = spark.read.option("header", True).csv(str(tmp_path / "d" / "top_negative")).orderBy("rank").collect()
    assert [r["feature"] for r in top] == ["b", "c"]


def test_splits_and_metrics_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="art-", dir="/tmp")
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "customerID long, split string")
    write_splits(df, os.path.join(base, "splits"))
    assert read_splits(spark, os.path.join(base, "splits"), "val").count() == 1
    m = spark.createDataFrame([("xgb", "val", 0.52, None), ("xgb", "test", None, 0.52)],
                              "model string, split string, chosen_threshold double, used_threshold double")
    art.write_metrics(m, os.path.join(base, "metrics"))
    back = art.read_metrics(spark, os.path.join(base, "metrics"))
    assert art.operating_threshold(back).first()["operating_threshold"] == 0.52
    only_val = back.where(F.col("split") == "val")
    assert art.operating_threshold(only_val).first()["operating_threshold"] == 0.52
    imp = spark.createDataFrame([("num__tenure", 0.5, 0.5, "Increases churn")],
                                "feature string, importance double, signed double, direction string")
    art.write_importance(imp, os.path.join(base, "imp"), "logreg", "coef_std")
    art.write_importance(imp, os.path.join(base, "imp"), "rf", "feature_importances")
    assert art.read_importance(spark, os.path.join(base, "imp"), "logreg").count() == 1


def test_missing_splits_raise(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        read_splits(spark, "/tmp/does-not-exist-churnscope")
