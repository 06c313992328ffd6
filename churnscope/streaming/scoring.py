"""I8: the retention list over a stream of subscriber rows.

``readStream`` of parquet files with the explicit raw schema -> the same
stateless projections as the batch path (serving features, fixture or
model score, actions) -> ``writeStream`` parquet with a checkpoint in the
shared folder.  Fitted scalars (medians, tier edges, operating threshold)
enter as literals, so no state store is needed; ``availableNow`` processes
what is there and stops, and restarting from the checkpoint continues
exactly-once after a failure.

``run_versioned_stream`` takes the fitted values from a table of versions instead, read
anew in every micro-batch and joined to its rows by time, and drops repeated
ids with state that a watermark bounds.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.operators import actions as ac
from churnscope.operators.features import serving_features
from churnscope.operators.stats import FeatureStats
from churnscope.sources.scored import scorer_column
from churnscope.sources.subscribers import RAW_COLUMNS, RAW_SCHEMA

#: A version holds from ``valid_from`` until the next one does.
VERSION_SCHEMA = ("valid_from timestamp, ratio_median double, monthly_median double, q1 double, q2 double, "
                  "q3 double, threshold double")
ARRIVED = "received"


def retention_stream(stream: DataFrame, stats: FeatureStats, model: str, threshold: float,
                     edges) -> DataFrame:
    feats = serving_features(stream, stats).withColumn("prob", scorer_column(model))
    return ac.retention_list(feats, threshold, edges)


def run_retention_stream(spark: SparkSession, source_dir: str, stats: FeatureStats, model: str,
                         threshold: float, edges, sink_dir: str, checkpoint_dir: str, schema=RAW_SCHEMA,
                         max_files: int | None = None) -> DataFrame:
    """Run the stream over the files present; return the sink as a table.

    ``checkpoint_dir`` keeps the progress: a later call with the same folders
    takes only files that have come since, and a call after a failure goes on
    where it stopped.  ``max_files`` bounds a micro-batch.  ``schema`` may hold
    more columns than the raw ones (they are dropped), with the raw total as
    ``TotalChargesText``.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    src = reader.parquet(source_dir)
    if "TotalChargesText" in src.columns:
        src = src.withColumn("TotalCharges", F.col("TotalChargesText"))
    q = (retention_stream(src.select(*RAW_COLUMNS), stats, model, threshold, edges)
         .writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink_dir)


def version_spans(versions: DataFrame) -> DataFrame:
    """Versions as ``_v`` structs with the span (``_from``, ``_until``) in which they hold.

    The first one also holds for all earlier rows (``_from`` is null).  Of versions with one
    time, the last in the order of their values holds; one without a time takes no part.
    """
    values = [F.col(c) for c in versions.columns]
    order = Window.orderBy(*values)  # one row a version
    return versions.where(F.col("valid_from").isNotNull()).select(
        F.struct(*values).alias("_v"), F.lead("valid_from").over(order).alias("_until"),
        F.when(F.row_number().over(order) > 1, F.col("valid_from")).alias("_from"))


def versioned_list(rows: DataFrame, versions: DataFrame, model: str) -> DataFrame:
    """The retention list of rows with a time ``received``, each by the version that held then.

    A row without a time counts as earlier than every version.  Without any version the
    decision is 0 and the value segment null.  The join is by ranges of time, with the versions (a
    row for each refit) broadcast; it depends on the rows and versions alone, so a batch that is
    repeated after a failure gives the same list.
    """
    at = F.col(ARRIVED)
    holds = ((F.col("_from").isNull() | F.coalesce(at >= F.col("_from"), F.lit(False)))
             & (F.col("_until").isNull() | F.coalesce(at < F.col("_until"), F.col("_from").isNull())))
    dated = rows.select(*RAW_COLUMNS, ARRIVED).join(F.broadcast(version_spans(versions)), holds, "left")
    v = F.col("_v")
    feats = serving_features(dated, FeatureStats(v["ratio_median"], v["monthly_median"]))
    scored = feats.withColumns({"prob": scorer_column(model), "_clv": F.when(v.isNotNull(), F.col("CLV"))})
    return ac.retention_list(scored, v["threshold"], [v["q1"], v["q2"], v["q3"]], clv_col="_clv")


def run_versioned_stream(spark: SparkSession, source_dir: str, versions_dir: str, model: str, sink_dir: str,
                         checkpoint_dir: str, delay: str = "1 day", max_files: int | None = None) -> DataFrame:
    """Score the files present with the versions present at each micro-batch; return the sink as a table.

    Of rows with one id that arrive within ``delay`` of each other only the first is listed; rows
    later than the watermark by then are dropped with it, which bounds the state.  A micro-batch
    writes its own folder of the sink, so a repeated batch replaces what it wrote.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(ARRIVED, T.TimestampType())])
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fresh = (reader.parquet(source_dir).withWatermark(ARRIVED, delay)
             .dropDuplicatesWithinWatermark(["customerID"]))

    def write(batch: DataFrame, number: int) -> None:
        versions = batch.sparkSession.read.schema(VERSION_SCHEMA).parquet(versions_dir)
        versioned_list(batch, versions, model).write.mode("overwrite").parquet(
            os.path.join(sink_dir, f"batch={number}"))

    q = (fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink_dir).drop("batch")
