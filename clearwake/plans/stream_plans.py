"""The streaming jobs run over the given tables; each gives the rows of its batch counterpart."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from clearwake.functions.trace import make_traceparent
from clearwake.operators.index import read_index
from clearwake.plans.inputs import CLASSIFIED, PACKETS, conversation_packets, moment, raw_envelopes
from clearwake.plans.ops_plans import sql_stamp, stamp_text
from clearwake.plans.registry import query, table
from clearwake.plans.text_plans import PAGE_MIN_BYTES
from clearwake.session import scratch_path
from clearwake.streaming.canary import stream_canary
from clearwake.streaming.jobs import (
    late_rows,
    stream_dedupe,
    stream_enrich,
    stream_error_ratio,
    stream_index,
    stream_latency,
    stream_sanitize,
    tick,
    with_ticks,
)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


#: Files of about so many bytes make a micro-batch.
BATCH_BYTES = 1 << 30


def staged(df: DataFrame, name: str) -> str:
    """``df`` as a folder of as many files as it has partitions, to be streamed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)


def drain(writer: DataStreamWriter) -> int:
    """Process what is there, then stop. Returns, and warns of, the number of rows that came too late."""
    job = writer.trigger(availableNow=True).start()
    late: dict[int, int] = {}
    ended = False
    while not ended:
        ended = bool(job.awaitTermination(1))
        # a query keeps its newest progress only
        for progress in job.recentProgress:
            late[progress.batchId] = max(late_rows(progress), late.get(progress.batchId, 0))
    total = sum(late.values())
    if total:
        warnings.warn(f"{total} rows came behind the watermark and are not in the result", stacklevel=2)
    return total


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Everything an append-mode stream emits, as a table."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    drain(
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}-checkpoint")
        .option("path", out)
    )
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end(name: str, build: Callable[..., DataFrame], *inputs: tuple[DataFrame, str, dict]) -> DataFrame:
    """``run_to_table`` of a stream whose inputs have ended, what was open at their end included.

    An input is a stream, the column of its time, and the marks of its tick.
    """
    spark = inputs[0][0].sparkSession
    out = scratch_path(spark, name)
    ticks = [f"{out}-ticks-{i}" for i in range(len(inputs))]
    stream = build(*(with_ticks(rows, folder) for (rows, _, _), folder in zip(inputs, ticks)))
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-checkpoint")
    drain(writer.option("path", out))
    for (rows, time, marks), folder in zip(inputs, ticks):
        tick(rows, folder, time, **marks)
    drain(writer.option("path", out))
    return spark.read.schema(stream.schema).parquet(out)


def staged_in_order(df: DataFrame, name: str, time: str, slices: int = 4) -> str:
    """``df`` as a folder of files in order of time: ``slices`` equal spans of it, one written after the other."""
    path = scratch_path(df.sparkSession, name)
    first, last = df.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    width = (last - first) // slices + 1
    for i in range(slices):
        span = F.unix_micros(time).between(first + i * width, first + (i + 1) * width - 1)
        df.where(span).coalesce(max(1, df.rdd.getNumPartitions() // slices)).write.mode("append").parquet(path)
    return path


_SANITIZED = f"""WITH {CLASSIFIED}
SELECT page_id, 'ok' AS branch, md5(clean) AS payload_md5, strlen(html) AS length, CAST(NULL AS VARCHAR) AS error FROM classified WHERE outcome = 'ok'
UNION ALL SELECT page_id, 'dlq', md5(value), NULL, 'empty_raw_html' FROM classified WHERE outcome = 'dlq'"""


def _branches(spark: SparkSession, out: str, dlq: str) -> DataFrame:
    ok = spark.read.parquet(out).select(
        "page_id", F.lit("ok").alias("branch"), F.md5("text").alias("payload_md5"), "length", F.lit(None).cast("string").alias("error")
    )
    dead = spark.read.parquet(dlq).select(
        "page_id", F.lit("dlq").alias("branch"), F.md5("payload").alias("payload_md5"), F.lit(None).cast("long").alias("length"), "error"
    )
    return ok.unionByName(dead)


@query("stream_sanitize", _SANITIZED)
def sanitize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = file_stream(spark, staged(raw_envelopes(spark, sf_dir), "raw"))
    out, dlq = scratch_path(spark, "sanitized"), scratch_path(spark, "raw-dlq")
    drain(stream_sanitize(packets, out, dlq, f"{out}-checkpoint", PAGE_MIN_BYTES, keep=("page_id",)))
    return _branches(spark, out, dlq)


def _lose_commit(spark: SparkSession, checkpoint: str, out: str) -> None:
    """What a driver leaves that dies in the middle of a micro-batch: some of its files, and no note that it is done."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(n) for s in files.listStatus(path(f"{checkpoint}/commits")) if (n := s.getPath().getName()).isdigit())
    files.delete(path(f"{checkpoint}/commits/{last}"), False)
    written = [s.getPath() for s in files.globStatus(path(f"{out}/run=*/batch_id={last}/*.parquet"))]
    for file in written[: max(1, len(written) // 2)]:
        files.delete(file, False)


@query("stream_restart", _SANITIZED)
def restarted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sanitizing stream, ended in mid-input and in the middle of a micro-batch, then started again: no row lost or twice."""
    raw = raw_envelopes(spark, sf_dir)
    source, out, dlq = (scratch_path(spark, n) for n in ("raw", "sanitized", "raw-dlq"))
    half = F.pmod(F.xxhash64("page_id"), F.lit(2))

    def run() -> None:
        packets = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(source)
        drain(stream_sanitize(packets, out, dlq, f"{out}-checkpoint", PAGE_MIN_BYTES, keep=("page_id",)))

    raw.where(half == 0).repartition(4).write.parquet(source)
    run()
    _lose_commit(spark, f"{out}-checkpoint", out)
    raw.where(half == 1).repartition(4).write.mode("append").parquet(source)
    run()
    return _branches(spark, out, dlq)


@query(
    "stream_enrich",
    f"""WITH {PACKETS}
SELECT conv_id * 4294967296 + turn AS id, 'ok' AS branch, md5(found_text) AS payload_md5, source_url, CAST(NULL AS VARCHAR) AS error
FROM parsed_packets WHERE quarantine IS NULL
UNION ALL SELECT NULL, 'dlq', md5(value), source_url, quarantine FROM parsed_packets WHERE quarantine IS NOT NULL""",
)
def enrich_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = conversation_packets(spark, sf_dir).select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"), "value")
    packets = file_stream(spark, staged(keyed, "packets"))
    out, dlq = scratch_path(spark, "index"), scratch_path(spark, "text-dlq")
    drain(stream_enrich(packets, out, dlq, f"{out}-checkpoint", id_column="id", model_version="risk-rules-v2"))
    ok = spark.read.parquet(out).select(
        F.col("id").cast("long").alias("id"),
        F.lit("ok").alias("branch"),
        F.md5("content").alias("payload_md5"),
        "source_url",
        F.lit(None).cast("string").alias("error"),
    )
    dead = spark.read.parquet(dlq).select(
        F.lit(None).cast("long").alias("id"), F.lit("dlq").alias("branch"), F.md5("payload").alias("payload_md5"), "source_url", "error"
    )
    return ok.unionByName(dead)


@query(
    "stream_index",
    f"""WITH {PACKETS}
SELECT DISTINCT sha256(value) AS id, md5(found_text) AS content_md5, source_url, 'v2' AS schema_version
FROM parsed_packets WHERE quarantine IS NULL""",
)
def index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that share a third of the packets, in many micro-batches, into one version: one row per packet."""
    packets = conversation_packets(spark, sf_dir).withColumn("third", F.pmod(F.xxhash64("value"), F.lit(3)))
    root, dlq = scratch_path(spark, "index"), scratch_path(spark, "text-dlq")
    for run, third in (("first", 2), ("second", 0)):
        path = staged(packets.where(F.col("third") != third).select("value").repartition(4), f"packets-{run}")
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).parquet(path)
        drain(stream_index(stream, root, "v2", dlq, f"{root}-checkpoint-{run}", "documents", model_version="risk-rules-v2"))
    out = read_index(spark, root, alias="documents")
    return out.select("id", F.md5("content").alias("content_md5"), "source_url", "schema_version")


def _outcomes(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 50).alias("deployment"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("failed"),
    )


DAY = 86_400

_DAILY = """
ratios AS (
  SELECT user_id % 50 AS deployment, time_bucket(INTERVAL '1 day', ts) AS ts, count(*) FILTER (event_type = 'error') AS failures,
         count(*) FILTER (event_type <> 'error') AS processed FROM events GROUP BY ALL),
daily AS (SELECT *, CASE WHEN processed = 0 THEN 0 ELSE failures / processed END AS ratio FROM ratios)"""


def _daily_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(stream_table(spark, sf_dir, "events"))
    return run_to_end("ratios", lambda rows: stream_error_ratio(rows, DAY), (outcomes, "ts", {}))


@query(
    "stream_error_ratio",
    f"WITH {_DAILY} SELECT deployment, {sql_stamp('ts', 'ts')}, failures, processed, round(ratio, 9) AS ratio FROM daily",
)
def error_ratio_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, the last one as well."""
    return _daily_ratios(spark, sf_dir).select(
        "deployment", stamp_text("ts"), "failures", "processed", F.round("ratio", 9).alias("ratio")
    )


@query(
    "stream_canary",
    f"""WITH {_DAILY}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY ts) AS n, min(ts) OVER (PARTITION BY deployment) AS start FROM daily),
seen AS (
  SELECT *, min(CASE WHEN ratio > 0.25 * 3 THEN n END) OVER (PARTITION BY deployment) AS spike
  FROM numbered WHERE n <= 8 AND ts < start + INTERVAL '8 days'),
used AS (SELECT * FROM seen WHERE spike IS NULL OR n <= spike)
SELECT CAST(deployment AS VARCHAR) AS deployment, count(*) AS samples, round(avg(ratio), 9) AS mean_ratio,
       CASE WHEN any_value(spike) IS NOT NULL THEN 'ROLLBACK_SPIKE' WHEN avg(ratio) > 0.25 THEN 'ROLLBACK_AVG' ELSE 'PROMOTE' END AS verdict
FROM used GROUP BY deployment""",
)
def canary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from a stream of daily ratios, itself the output of a stream: by a spike, eight samples, or eight days."""
    ratios = _daily_ratios(spark, sf_dir).select(F.col("deployment").cast("string").alias("deployment"), "ts", "ratio")
    path = staged_in_order(ratios, "ratio-files", "ts")
    samples = spark.readStream.schema(ratios.schema).option("maxFilesPerTrigger", 2).parquet(path)
    # samples behind a gap wait for the watermark; files of a quarter of the time may come in any order
    spans = ratios.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 4).first()[0]

    def verdicts(rows: DataFrame) -> DataFrame:
        return stream_canary(rows, threshold=0.25, interval_s=DAY, timeout_s=8 * DAY, delay=f"{int(spans) + DAY} seconds")

    found = run_to_end("verdicts", verdicts, (samples, "ts", {"deployment": "-", "ratio": 0.0}))
    return found.withColumn("mean_ratio", F.round("mean_ratio", 9))


@query(
    "stream_latency",
    """SELECT page_id, CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN CAST(30 + (page_id * 37) % 150 AS DOUBLE) END AS latency_s
FROM pages""",
)
def latency_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies from a join of two streams on trace id; of a packet that is indexed two hours later, or never, a null one."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", make_traceparent("page_id").alias("traceparent"))
    raw = pages.withColumn("collected_at", moment(n).cast("timestamp"))
    wait = F.when(n % 11 == 0, 7200).otherwise(30 + (n * 37) % 150)
    index = pages.where("page_id % 7 <> 0").withColumn("timestamp", moment(n + wait).cast("timestamp"))
    sides = []
    for rows, time in ((raw, "collected_at"), (index, "timestamp")):
        path = staged_in_order(rows, time, time)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
        sides.append((stream, time, {"traceparent": f"00-{'f' * 32}-{'f' * 16}-01"}))
    span = raw.agg(F.unix_seconds(F.max("collected_at")) - F.unix_seconds(F.min("collected_at"))).first()[0]
    # files of a quarter of the time may come in any order
    found = run_to_end("latency", lambda a, b: stream_latency(a, b, delay=f"{span // 4 + 7200} seconds"), *sides)
    keys = pages.select("page_id", F.substring("traceparent", 4, 32).alias("trace_id"))
    return found.join(keys, "trace_id").select("page_id", "latency_s")


@query("stream_dedupe", "SELECT DISTINCT 'https://site.example/u/' || CAST(user_id % 40 AS VARCHAR) AS url FROM events")
def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL once, out of many visits."""
    visits = stream_table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://site.example/u/"), (F.col("user_id") % 40).cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return run_to_table(stream_dedupe(visits, delay="60 days"), "urls").select("url")
