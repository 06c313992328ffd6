"""Stream scoring: equal to batch, and a restart from the checkpoint adds nothing."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from churnscope.operators import actions as ac
from churnscope.operators.features import serving_features
from churnscope.operators.split import hash_split
from churnscope.operators.stats import FeatureStats
from churnscope.plans.prep import prepared
from churnscope.sources.scored import scorer_column
from churnscope.sources.subscribers import load_subscribers
from churnscope.streaming.scoring import VERSION_SCHEMA, run_retention_stream, run_versioned_stream, versioned_list
from tests.conftest import SF_SMALL, make_raw


def test_stream_equals_batch_and_goes_on_from_its_checkpoint(spark):
    table = prepared(spark, SF_SMALL)
    raw = table.raw(spark)
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink, ckpt = (os.path.join(base, n) for n in ("src", "sink", "ckpt"))
    stats, edges = FeatureStats(1 / 6, 70.0), [300.0, 500.0, 900.0]
    halves = raw.randomSplit([0.5, 0.5], seed=1)

    def run():
        return run_retention_stream(spark, src, stats, "logreg", 0.5, edges, sink, ckpt, max_files=2)

    halves[0].repartition(5).write.parquet(src)
    assert run().count() == halves[0].count()          # several micro-batches
    assert run().count() == halves[0].count()          # the files were already consumed
    halves[1].write.mode("append").parquet(src)
    out = run()                                         # only the new files
    batch = ac.retention_list(serving_features(raw, stats).withColumn("prob", scorer_column("logreg")),
                              0.5, edges)
    assert out.count() == batch.count() == raw.count()
    assert out.exceptAll(batch.select(out.columns)).count() == 0


def _version(spark, day, threshold):
    when = datetime(2024, 1, day)
    return spark.createDataFrame([(when, 0.1, 70.0, 300.0, 500.0, 900.0, threshold)], VERSION_SCHEMA)


def _dated(spark, ids, day):
    rows = make_raw(spark, [{"customerID": i, "tenure": 1, "InternetService": "Fiber optic"} for i in ids])
    return rows.withColumn("received", F.lit(datetime(2024, 1, day, 12)))


def test_a_new_version_takes_effect_between_batches(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, versions, sink, ckpt = (os.path.join(base, n) for n in ("src", "versions", "sink", "ckpt"))
    run = lambda: run_versioned_stream(spark, src, versions, "logreg", sink, ckpt)
    _version(spark, 1, 0.0).write.parquet(versions)
    _dated(spark, ["a", "b", "b"], 2).write.parquet(src)
    assert sorted((r.customerID, r.decision) for r in run().collect()) == [("a", 1), ("b", 1)]
    _version(spark, 3, 1.5).write.mode("append").parquet(versions)
    late = _dated(spark, ["d"], 2)                       # arrives after the change, received before it
    _dated(spark, ["b"], 2).unionByName(_dated(spark, ["c"], 3)).unionByName(late).write.mode("append").parquet(src)
    out = run()                                          # b again: listed once
    assert sorted((r.customerID, r.decision) for r in out.collect()) == [("a", 1), ("b", 1), ("c", 0), ("d", 1)]
    assert run().count() == 4


def test_versions_by_time(spark):
    """Rows before all versions, at a change, without a time; versions of one time or none."""
    versions = (_version(spark, 2, 0.0).unionByName(_version(spark, 4, 0.0)).unionByName(_version(spark, 4, 1.5))
                .unionByName(_version(spark, 9, 0.0).withColumn("valid_from", F.lit(None).cast("timestamp"))))
    rows = _dated(spark, ["early"], 1).unionByName(_dated(spark, ["mid"], 3)).unionByName(
        _dated(spark, ["end"], 5)).unionByName(
        _dated(spark, ["edge"], 4).withColumn("received", F.lit(datetime(2024, 1, 4)))).unionByName(
        _dated(spark, ["none"], 4).withColumn("received", F.lit(None).cast("timestamp")))
    got = {r.customerID: r.decision for r in versioned_list(rows, versions, "logreg").collect()}
    assert got == {"early": 1, "mid": 1, "edge": 0, "end": 0, "none": 1}
    unknown = versioned_list(rows, versions.limit(0), "logreg").collect()
    assert len(unknown) == 5 and all(r.decision == 0 and r.value_segment is None for r in unknown)


def test_prepared_is_written_once_per_input(spark):
    a, b = prepared(spark, SF_SMALL), prepared(spark, SF_SMALL)
    assert a is b
    other = prepared(spark, "/root/testdata/sf0.01")
    assert other.path != a.path and other.raw(spark).count() > a.raw(spark).count()
    assert a.raw(spark).exceptAll(load_subscribers(spark, SF_SMALL)).count() == 0


def test_hash_split_is_stable_and_shuffle_free(spark):
    df = spark.range(5000).withColumnRenamed("id", "customerID")
    s1 = hash_split(df)
    plan = spark._jvm.PythonSQLUtils.explainString(s1._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan
    shares = {r["split"]: r["count"] for r in s1.groupBy("split").count().collect()}
    assert abs(shares["train"] / 5000 - 0.6) < 0.03
    s2 = hash_split(df.where(F.col("customerID") % 2 == 0))
    joined = s1.join(s2, "customerID").where(s1["split"] != s2["split"])
    assert joined.count() == 0
