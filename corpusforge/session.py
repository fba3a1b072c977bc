"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session defaults. Everything here can be overridden by the cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows hold whole texts: keep Arrow batches small enough for long documents.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "corpusforge", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the library defaults, then the caller's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a session whose tasks run in this process may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", None) or spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corpusforge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to a Parquet table in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, keeps column pruning for the
    readers, and fixes values such as partition ids that would otherwise be recomputed.
    `discard` deletes the table when nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by `materialize`; only folders directly under the shared folder are touched."""
    for table in tables:
        spark = table.sparkSession
        files = table.inputFiles()
        if not files:
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if folder.getParent().equals(store.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)))):
            store.delete(folder, True)
