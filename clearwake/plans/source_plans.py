"""Readers and writers over the given tables: what is written is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_packet, parse_packet_with_meta
from clearwake.functions.trace import make_traceparent
from clearwake.operators.sanitize import classify_raw, split
from clearwake.operators.telemetry import burn_rate_of_summaries
from clearwake.plans.inputs import CLASSIFIED, PACKETS, REQUESTS, SAMPLES, conversation_packets, event_requests, event_samples, raw_envelopes
from clearwake.plans.ops_plans import sql_stamp, stamp_text
from clearwake.plans.registry import query, table
from clearwake.plans.text_plans import PAGE_MIN_BYTES
from clearwake.schemas import DLQ
from clearwake.session import scratch_path
from clearwake.sources.readers import read_raw, read_samples, read_sanitized
from clearwake.sources.writers import write_dlq, write_raw, write_sanitized


@query(
    "raw_files",
    "SELECT url AS source_url, md5(html) AS html_md5, NOT contains(html, chr(10)) AS one_line, count(*) AS packets FROM pages GROUP BY ALL",
)
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes as text files, one a line, whatever line breaks the pages have."""
    path = scratch_path(spark, "raw-files")
    pages = table(spark, sf_dir, "pages")
    write_raw(
        pages.select(
            F.col("html").alias("raw_html"),
            F.col("url").alias("source_url"),
            F.lit("2024-01-01T00:00:00Z").alias("collected_at"),
            make_traceparent("page_id").alias("traceparent"),
        ),
        path,
    )
    envelope = F.from_json("value", "raw_html string, source_url string").alias("p")
    html = F.col("p.raw_html")
    return (
        read_raw(spark, path)
        .select(envelope)
        .groupBy(F.col("p.source_url").alias("source_url"), F.md5(html).alias("html_md5"), (~html.contains("\n")).alias("one_line"))
        .agg(F.count(F.lit(1)).alias("packets"))
    )


@query(
    "sanitized_files",
    """SELECT 'https://chat.example/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS source_url, md5(text) AS text_md5,
false AS fallback FROM conversations WHERE text <> ''""",
)
def sanitized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitized packets as text files, read and parsed."""
    path = scratch_path(spark, "sanitized-files")
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    url = F.concat_ws("/", F.lit("https://chat.example"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    write_sanitized(
        turns.select(
            "text",
            F.octet_length("text").cast("long").alias("length"),
            url.alias("source_url"),
            F.lit(None).cast("string").alias("traceparent"),
        ),
        path,
    )
    parsed = parse_packet_with_meta(read_sanitized(spark, path))
    return parsed.select("source_url", F.md5("text").alias("text_md5"), "fallback")


@query(
    "dlq_files",
    f"""WITH {CLASSIFIED}
SELECT 'sanitizer' AS stage, 'empty_raw_html' AS error, md5(value) AS payload_md5, count(*) AS letters
FROM classified WHERE outcome = 'dlq' GROUP BY ALL""",
)
def dlq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead-letter sink, filled twice over by halves of the pages."""
    path = scratch_path(spark, "dlq-files")
    dead = split(classify_raw(raw_envelopes(spark, sf_dir), PAGE_MIN_BYTES)).dlq
    half = F.pmod(F.xxhash64("raw_payload"), F.lit(2))
    for part in range(2):
        write_dlq(dead.where(half == part), path, "sanitizer")
    letters = spark.read.schema(DLQ).parquet(path)
    return letters.groupBy("stage", "error", F.md5("payload").alias("payload_md5")).agg(F.count(F.lit(1)).alias("letters"))


@query("sample_files", f"WITH {SAMPLES} SELECT job, metric, {sql_stamp('ts', 'ts')}, value FROM samples")
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sample-files")
    event_samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return read_samples(spark, path).select("job", "metric", stamp_text("ts"), "value")


@query("packet_text", f"WITH {PACKETS} SELECT conv_id, turn, md5(found_text) AS text_md5 FROM parsed_packets")
def packet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a packet as one expression."""
    packets = conversation_packets(spark, sf_dir)
    return packets.select("conv_id", "turn", F.md5(parse_packet("value")).alias("text_md5"))


@query(
    "burn_rate_summaries",
    f"""WITH {REQUESTS}, daily AS (
  SELECT service, time_bucket(INTERVAL '1 day', ts) AS day, avg(CAST(failed AS INT)) AS failed_rate FROM requests GROUP BY ALL),
named AS (
  SELECT *, CASE dayofmonth(day) % 3 WHEN 2 THEN NULL ELSE failed_rate END AS rate FROM daily)
SELECT service, {sql_stamp('day', 'day')}, round(rate, 9) AS failed_rate, round(rate / (1 - 0.9::DOUBLE), 6) AS burn_rate,
       CASE WHEN rate IS NULL THEN 'error' WHEN rate / (1 - 0.9::DOUBLE) > 2.0 THEN 'fail' ELSE 'pass' END AS verdict FROM named""",
)
def burn_of_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of each service and day with a failure rate, with checks only, or with neither."""
    rates = event_requests(spark, sf_dir).groupBy("service", F.date_trunc("day", "ts").alias("day")).agg(
        F.avg(F.col("failed").cast("double")).alias("rate")
    )
    kind = F.dayofmonth("day") % 3

    def rate(when: int, value: Column) -> Column:
        return F.struct(F.struct(F.when(kind == when, value).alias("rate")).alias("values"))

    summaries = rates.select(
        "service", "day", F.struct(rate(0, F.col("rate")).alias("http_req_failed"), rate(1, 1 - F.col("rate")).alias("checks")).alias("metrics")
    )
    found = burn_rate_of_summaries(summaries, slo=0.9)
    return found.select("service", stamp_text("day"), F.round("failed_rate", 9).alias("failed_rate"), F.round("burn_rate", 6).alias("burn_rate"), "verdict")
