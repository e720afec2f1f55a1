"""Readers with fixed schemas, for batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.operators.access import DEFAULT_ROLE
from clearwake.schemas import CASES, ENTITIES, LOAD_SUMMARY, SAMPLES, USERS

PACKET_SCHEMA = "value STRING"


def read_packets(
    spark: SparkSession, path: str, stream: bool = False, fmt: str = "text", **options: str
) -> DataFrame:
    """Packets, one string ``value`` per row, from text files, a Parquet table or Kafka.

    With ``fmt="kafka"`` the options are those of the Kafka source and ``path`` is the topic.
    """
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    if fmt == "kafka":
        return reader.option("subscribe", path).load().select(F.col("value").cast("string").alias("value"))
    return reader.schema(PACKET_SCHEMA).load(path)


def read_raw(spark: SparkSession, path: str, stream: bool = False, fmt: str = "text", **options: str) -> DataFrame:
    """Raw page envelopes as the collector writes them."""
    return read_packets(spark, path, stream, fmt, **options)


def read_sanitized(
    spark: SparkSession, path: str, stream: bool = False, fmt: str = "text", **options: str
) -> DataFrame:
    """Sanitized packets."""
    return read_packets(spark, path, stream, fmt, **options)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON array files; ``entities`` may be left out."""
    cases = spark.read.schema(CASES).option("multiLine", True).json(path)
    return cases.withColumn("entities", F.coalesce("entities", F.array().cast(ENTITIES)))


def read_samples(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    """Metric samples ``job, metric, ts, value``."""
    return (spark.readStream if stream else spark.read).schema(SAMPLES).format(fmt).load(path)


def read_load_summary(spark: SparkSession, path: str) -> DataFrame:
    """Load-test summaries, one JSON document per file; absent rates are null."""
    return spark.read.schema(LOAD_SUMMARY).option("multiLine", True).json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Configuration documents, one file each: ``doc_id`` (file path) and ``body``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """``username, role`` from a user file; a user without a role is a viewer."""
    listed = spark.read.schema(USERS).option("multiLine", True).json(path)
    return listed.select(F.inline("users")).select(
        "username", F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role")
    )
