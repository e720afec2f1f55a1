"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_CONF = {
    # document timestamps are UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key is not an error: the last one wins
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "clearwake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clearwake-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/clearwake/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably, so later stages neither recompute it nor depend on its executors."""
    base = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a scan that has fewer splits than cores over the idle ones; leave a large scan alone.

    A file with one row group is one task however costly the work on its rows is. A scan with
    enough splits, which is any large one, is returned as it is and not shuffled.
    """
    spark = df.sparkSession
    wanted = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Stored copy of ``df``, marked for broadcast only when it was counted to be small.

    Above ``max_rows`` the copy carries no hint and Spark joins it by shuffle.
    """
    stored = cut_lineage(df)
    small = stored.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(stored) if small else stored
