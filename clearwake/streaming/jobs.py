"""The operators as Structured Streaming jobs.

Each stage uses the batch functions unchanged. Delivery is at least once; a repeated micro-batch
replaces its own output, so results do not change when a job is stopped and restarted. A new checkpoint is a new run,
which adds to the output of others: packets it reads again are stored again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from clearwake.functions.trace import valid_trace_id
from clearwake.operators.dlq import normalise_dlq
from clearwake.operators.enrich import enrich
from clearwake.operators.index import write_index
from clearwake.operators.sanitize import MIN_TEXT_BYTES, classify_raw, split
from clearwake.operators.telemetry import outcome_ratio
from clearwake.schemas import INDEX
from clearwake.sources.writers import write_batch


def _batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def _run(batch: DataFrame) -> str:
    """The id of the stream a micro-batch is from. It is kept in the checkpoint, so it outlives restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


#: Later than any row: a tick of this time ends a stream. Times in nanoseconds, as pandas has them, end in 2262.
END_OF_TIME = datetime(2250, 1, 1)


def with_ticks(rows: DataFrame, ticks: str) -> DataFrame:
    """``rows`` and what ``tick`` writes to the folder ``ticks``, made if it isn't there.

    A watermark only moves with rows, so the last windows of an input that has ended stay open. A tick is a row of its own
    key whose time moves the watermark past them: the next run from the same checkpoint closes what is open, by the rules
    that closed the rest. Rows that come after the final tick are late.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(ticks)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(ticks))


def tick(rows: DataFrame, ticks: str, time: str, at: datetime = END_OF_TIME, **marks) -> None:
    """Write a tick for ``rows``: ``time`` is ``at``, ``marks`` are columns that must not be null, the others are.

    The tick is a row for the operators too. Where it ends a stream its own window, or wait, is never over, so no result
    comes of it.
    """
    values = {time: at, **marks}
    columns = (F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields)
    rows.sparkSession.range(1).select(*columns).write.mode("append").parquet(ticks)


def late_rows(progress) -> int:
    """Rows that a micro-batch dropped because they came behind the watermark, from a query's progress.

    As the state operators see them: rows of one window and key that an aggregation has already merged count once.
    """
    return sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)


def stream_sanitize(
    raw: DataFrame, out: str, dlq: str, checkpoint: str, min_bytes: int = MIN_TEXT_BYTES, value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataStreamWriter:
    """Raw packets to a clean-text table and a dead-letter table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        classified = classify_raw(batch, min_bytes, value).persist()
        try:
            parts = split(classified, value, keep)
            write_batch(parts.ok, out, _run(batch), batch_id)
            write_batch(normalise_dlq(parts.dlq, "sanitizer", keep), dlq, _run(batch), batch_id)
        finally:
            classified.unpersist()

    return _batches(raw, checkpoint, handle)


def stream_enrich(sanitized: DataFrame, out: str, dlq: str, checkpoint: str, **options) -> DataStreamWriter:
    """Sanitized packets to index rows and quarantined dead letters; options as for ``enrich``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            parts = enrich(stored, **options)
            write_batch(parts.ok, out, _run(batch), batch_id)
            write_batch(normalise_dlq(parts.dlq, "brain"), dlq, _run(batch), batch_id)
        finally:
            stored.unpersist()

    return _batches(sanitized, checkpoint, handle)


def stream_index(
    sanitized: DataFrame, root: str, version: str, dlq: str, checkpoint: str, alias: str | None = None, **options
) -> DataStreamWriter:
    """Sanitized packets into a version of the index, one row per packet id; options as for ``enrich``.

    A packet that comes again, in another micro-batch or another run, takes the place of its row. A micro-batch that was
    committed before changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            run = _run(batch)
            parts = enrich(stored, schema_version=version, **options)
            write_index(parts.ok.select(*INDEX.names), root, version, options["model_version"], alias, (run, batch_id))
            write_batch(normalise_dlq(parts.dlq, "brain"), dlq, run, batch_id)
        finally:
            stored.unpersist()

    return _batches(sanitized, checkpoint, handle)


def stream_error_ratio(
    outcomes: DataFrame, seconds: int = 60, delay: str = "1 minute", key: str = "deployment", denominator: str = "processed"
) -> DataFrame:
    """Failure ratio per deployment and window of outcome events; later rows than ``delay`` are dropped, ``late_rows`` counts them."""
    return outcome_ratio(outcomes.withWatermark("ts", delay), seconds, key, denominator)


def stream_latency(
    raw: DataFrame, index: DataFrame, delay: str = "10 minutes", limit: str = "1 hour"
) -> DataFrame:
    """Seconds from collection to indexing, joined on trace id within ``limit``.

    A packet that no index row meets within it has one row with null ``indexed_at`` and ``latency_s``, given when the
    watermarks of both sides have passed the limit. Rows behind the watermarks are dropped; ``late_rows`` counts them.
    Invalid (all-zero) trace ids are dropped first: they do not identify a packet and would all
    meet in one partition.
    """
    starts = raw.select(
        valid_trace_id("traceparent").alias("trace_id"), F.col("collected_at").cast("timestamp").alias("collected_at")
    ).where("trace_id IS NOT NULL").withWatermark("collected_at", delay)
    ends = index.select(
        valid_trace_id("traceparent").alias("end_trace_id"), F.col("timestamp").cast("timestamp").alias("indexed_at")
    ).where("end_trace_id IS NOT NULL").withWatermark("indexed_at", delay)
    within = (
        (F.col("trace_id") == F.col("end_trace_id"))
        & (F.col("indexed_at") >= F.col("collected_at"))
        & (F.col("indexed_at") <= F.col("collected_at") + F.expr(f"INTERVAL {limit}"))
    )
    return starts.join(ends, within, "left").select(
        "trace_id",
        "collected_at",
        "indexed_at",
        ((F.unix_micros("indexed_at") - F.unix_micros("collected_at")) / F.lit(1_000_000.0)).alias("latency_s"),
    )


def stream_dedupe(links: DataFrame, delay: str = "1 hour", url: str = "url", time: str = "ts", spread: int = 16) -> DataFrame:
    """Each URL once within the watermark.

    Rows are first thinned per (URL, slice of their time), so a URL that is most of the input
    reaches the final step as at most ``spread`` rows per interval. Both steps forget what is older than ``delay``, the first
    one per slice. So a URL that comes back after ``delay`` may be held by its slice once more, where a single step would
    let it through: its next row in another slice, or after that slice has expired, is given instead.
    """
    sliced = links.withColumn("_slice", F.pmod(F.xxhash64(time), F.lit(spread)))
    thinned = sliced.withWatermark(time, delay).dropDuplicatesWithinWatermark([url, "_slice"])
    return thinned.drop("_slice").dropDuplicatesWithinWatermark([url])
