"""Correlating the stages of a packet by trace id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.staging import pin
from clearwake.functions.trace import valid_trace_id
from clearwake.operators.order_stats import quantile

STAGES = ("raw", "sanitized", "index", "dlq")


def _tagged(df: DataFrame, stage: str, **extra: Column) -> DataFrame:
    tagged = df.select(
        valid_trace_id("traceparent").alias("trace_id"),
        F.lit(stage).alias("stage"),
        *(c.alias(n) for n, c in extra.items()),
    )
    return pin(tagged, "trace_id").where("trace_id IS NOT NULL")


def trace_lineage(raw: DataFrame, sanitized: DataFrame, index: DataFrame, dlq: DataFrame) -> DataFrame:
    """One row per trace: packets seen at each stage, final outcome, first gap.

    The stages are counted together in one aggregation instead of being joined pairwise: one
    shuffle of (trace, stage) counts, and repeated trace ids neither multiply nor pile up.
    """
    stages = dict(zip(STAGES, (raw, sanitized, index, dlq)))
    tagged = None
    for stage, df in stages.items():
        part = _tagged(df, stage)
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("trace_id").agg(
        *(F.count_if(F.col("stage") == s).alias(f"{s}_packets") for s in STAGES)
    )
    outcome = (
        F.when(F.col("index_packets") > 0, "indexed")
        .when(F.col("dlq_packets") > 0, "dead_letter")
        .when(F.col("sanitized_packets") > 0, "lost_before_index")
        .when(F.col("raw_packets") > 0, "lost_before_sanitized")
    )
    gap = (
        F.when((F.col("raw_packets") == 0), "raw")
        .when((F.col("sanitized_packets") == 0) & (F.col("index_packets") > 0), "sanitized")
    )
    return counts.withColumn("outcome", outcome).withColumn("missing_stage", gap)


def lost_packets(lineage: DataFrame) -> DataFrame:
    """Traces that entered the flow and came out nowhere."""
    return lineage.where(F.col("outcome").startswith("lost_"))


def ingest_latency(raw: DataFrame, index: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Seconds from first collection to last indexing, per trace seen at both ends.

    Expects ``collected_at`` and ``timestamp`` as timestamps. ``keep`` names columns of ``index``.
    """
    empty = F.lit(None)
    starts = _tagged(raw, "raw", at=F.col("collected_at").cast("timestamp"), **{k: empty.cast(index.schema[k].dataType) for k in keep})
    ends = _tagged(index, "index", at=F.col("timestamp").cast("timestamp"), **{k: F.col(k) for k in keep})
    is_raw = F.col("stage") == "raw"
    return (
        starts.unionByName(ends)
        .groupBy("trace_id")
        .agg(
            F.min(F.when(is_raw, F.col("at"))).alias("collected_at"),
            F.max(F.when(~is_raw, F.col("at"))).alias("indexed_at"),
            *(F.max(k).alias(k) for k in keep),
        )
        .where("collected_at IS NOT NULL AND indexed_at IS NOT NULL")
        .withColumn(
            "latency_s",
            (F.unix_micros("indexed_at") - F.unix_micros("collected_at")) / F.lit(1_000_000.0),
        )
    )


def latency_p95(latency: DataFrame, keys: Sequence[str], objective_s: float = 120.0) -> DataFrame:
    """Exact p95 per group against the ingest objective."""
    return quantile(latency, keys, "latency_s", 0.95, "p95_s").withColumn(
        "within_objective", F.col("p95_s") < objective_s
    )
