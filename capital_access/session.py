"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("capital_access")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Call sites are recorded per column expression, which slows the writing of wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session without that setting uses its warehouse, which Spark's own tables
    need on shared storage in any case. On a cluster, a warehouse that is a
    local folder, as it is unless set, would leave each executor's rows on its
    own disk: that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if urlparse(warehouse).scheme in ("", "file") and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("executors share no folder: set spark.checkpoint.dir, or spark.sql.warehouse.dir to a folder of a shared store")
    return f"{warehouse}/scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/capital_access/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a reduced table to the shared folder and go on from there; runs one job.

    Used where a table aggregated from the facts is read more than once:
    without it, each reader prunes other columns, nothing is reused, and the
    facts are scanned again. The written table also survives lost executors.
    """
    return settle_at(df, scratch_path(df.sparkSession, label))


def settle_at(df: DataFrame, path: str) -> DataFrame:
    """:func:`settle` at a path from :func:`scratch_path` or below one, so that several tables can be read as one."""
    spark = df.sparkSession
    # What was shuffled for a table is of no use once that is written.
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    return spark.read.schema(df.schema).parquet(path)
