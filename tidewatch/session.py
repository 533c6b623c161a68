"""Session defaults, and the folder long lineages are cut into."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join only counts as skewed past this size; the stock 256 MB leaves a hot
    # host alone until it already hurts.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rows handed to Python at a time; the stock 10,000 are too many where a row is a page.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def get_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; anything already set on the cluster wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL defaults this library relies on to an existing session.

    Two settings are forced because results depend on them: every instant is in
    UTC, and zone-less timestamps are read as instants.  The
    other settings are tuning and only fill gaps left by the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Zone-less parquet timestamps are instants in UTC, so filters on them push down.
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir``.

    Where none is named a folder of this machine serves a local master only; on a
    cluster the other machines would not see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that every machine of the cluster shares")
    import tempfile

    made = tempfile.mkdtemp(prefix="tidewatch-", dir=os.environ.get("TIDEWATCH_SCRATCH"))
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors cost no replay."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)
