"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants; a cluster's own spark-defaults win where set.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Joins without a mark broadcast only what Spark measures or estimates below this.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "sectional", extra: dict | None = None) -> SparkSession:
    """Return a session; local runs bind the driver to the loopback address."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.driver.host", "127.0.0.1")
                       .config("spark.driver.bindAddress", "127.0.0.1")
                       .config("spark.driver.memory", os.environ.get("SECTIONAL_DRIVER_MEMORY", "16g")))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; invent one only in local mode.

    On a cluster the folder must be shared storage that survives executor loss,
    so a missing setting is an error there rather than a silent local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this cluster")
        configured = tempfile.mkdtemp(prefix="sectional-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Spark's own removal of an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the executions inside; the earlier ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of an Arrow batch: a Python worker holds a few copies of one.
ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """At most ``ARROW_ROWS`` rows in an Arrow batch of the session, for rows that hold whole texts or sequences."""
    now = int(spark.conf.get(_ARROW_ROWS))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))


def cut_lineage(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Once the table is written, the shuffle files of its computation are of no use any more and are removed, so that a job of
    many stages doesn't keep them all on disk.

    Cuts the lineage like ``checkpoint()`` but computes the data once (a
    reliable RDD checkpoint of an uncached DataFrame recomputes it for the
    write) and re-reads it columnar, with pruning. The folder is the cluster's
    shared ``spark.checkpoint.dir``, so the table survives executor loss.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with settings(spark, **{_CLEANUP: "true"}):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``cut_lineage`` wrote, once nothing reads it any more; other tables stay."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark)).toUri().getPath()
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if os.path.dirname(path.toUri().getPath()) == own.rstrip("/"):
            path.getFileSystem(conf).delete(path, True)
