"""Sinks for dead letters and queue packets. The versioned document table is in operators.index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwake.functions.packets import to_raw_json, to_sanitized_json
from clearwake.operators.dlq import normalise_dlq


def write_dlq(df: DataFrame, path: str, stage: str) -> None:
    """Append failures in the one DLQ schema."""
    normalise_dlq(df, stage).write.mode("append").parquet(path)


def write_raw(df: DataFrame, path: str) -> None:
    """Append crawl envelopes as JSON text, one per row."""
    df.select(to_raw_json().alias("value")).write.mode("append").text(path)


def write_sanitized(df: DataFrame, path: str) -> None:
    """Append sanitized packets as JSON text, one per row."""
    df.select(to_sanitized_json().alias("value")).write.mode("append").text(path)


def write_exposition(lines: DataFrame, path: str) -> None:
    """Metrics text ordered by name; there is one row per counter."""
    lines.orderBy("metric").coalesce(1).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_batch(df: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Write a micro-batch so that repeating it replaces its own rows and no others.

    ``run`` names the stream: numbers of batches start anew with each checkpoint.
    """
    (
        df.withColumns({"run": F.lit(f"run-{run}"), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "batch_id")
        .parquet(path)
    )
