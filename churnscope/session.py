"""Spark session helpers.

Everything in the library takes a ``SparkSession`` from the caller.  The
builder below is only a convenience for tests, the bench and scripts; on a
cluster the session comes from ``spark-submit`` and its settings win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "churnscope") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHURNSCOPE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    and Spark runs in local mode (tests, the bench) a fresh scratch folder is
    created and set; on a cluster an unset folder is an error.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is not shared by executors: require the setting
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by the cluster "
                               "(HDFS, S3, ...) before running churnscope jobs")
        current = tempfile.mkdtemp(prefix="churnscope-ckpt-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder that goes when the application ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), "stash", f"{name}-{uuid.uuid4().hex}")
    _delete_at_end(spark, path)
    return path


#: Hint for the side of a join that must not be broadcast by Spark's own estimate: it takes an exploded table for one
#: entry a row, and a written one for its compressed bytes, so tables far over the threshold would go through the driver.
SORTED = "merge"
#: Parquet settings for rows of megabytes: row groups of a few rows.  Spark's default asks for the size only at the
#: hundredth row, and a task holds a whole row group as it writes and as it reads.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1,
              "parquet.block.size.row.check.min": 1}


def write_stash(df, name: str, partition_by: str | list[str] | None = None, options: dict | None = None) -> str:
    """Write ``df`` as parquet, with these options, under the shared checkpoint folder; return the path.

    Cuts the lineage (a lost executor recomputes from the written files, not
    from the source tables) and lets later jobs prune columns and, with
    ``partition_by``, partitions.  The folder is the cluster's
    ``spark.checkpoint.dir``; a scratch folder is used only where unset.  What
    is not released before goes when the application ends.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return path


def stash(df, name: str, partition_by: str | list[str] | None = None, options: dict | None = None):
    """``write_stash`` and read the written table back."""
    path = write_stash(df, name, partition_by, options)
    out = df.sparkSession.read.parquet(path)
    out._stash_path = path
    return out


def spread(df):
    """``df`` dealt evenly to twice as many parts as cores, for work that is large beside the bytes it reads:
    files of few bytes are otherwise read by few tasks."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete ``path`` when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames) -> None:
    """Delete the tables behind frames that ``stash`` returned.

    Only for tables that no frame still in use reads: what was derived from
    them must itself have been written.
    """
    for df in frames:
        delete_path(df.sparkSession, df._stash_path)
