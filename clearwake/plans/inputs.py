"""Operator inputs derived from the given tables, each with the same derivation in SQL.

The tables hold no risk keywords, packets or configuration documents, so these are built from
their rows: every input grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearwake.functions.packets import to_raw_json
from clearwake.functions.text import RISK_KEYWORDS, WHITE_SPACE
from clearwake.functions.trace import make_traceparent
from clearwake.operators.enrich import enrich_text
from clearwake.operators.entities import gazetteer_extractor
from clearwake.plans.registry import table, wide_table

# Frequent words of the documents, with an entity type each.
GAZETTEER = (
    ("the", "ORG"),
    ("and", "PERSON"),
    ("with", "GPE"),
    ("which", "ORG"),
    ("les", "PERSON"),
    ("dans", "GPE"),
    ("une", "ORG"),
    ("und", "PERSON"),
    ("nicht", "GPE"),
    ("los", "ORG"),
    ("para", "PERSON"),
    ("que", "GPE"),
)
EPOCH = "2024-01-01 00:00:00"


def moment(offset: Column, unit: str = "SECOND") -> Column:
    """A UTC timestamp that many units after the fixed start."""
    part = {"SECOND": "secs", "MINUTE": "mins", "HOUR": "hours"}[unit]
    parts = {"secs": F.lit(0), "mins": F.lit(0), "hours": F.lit(0)} | {part: offset.cast("int")}
    return F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(F.lit(0), parts["hours"], parts["mins"], parts["secs"])


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- documents -----------------------------------------------------------------------------------


def seeded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 0 to 8 risk keywords appended, and a link and a mention in every fourth."""
    docs = wide_table(spark, sf_dir, "documents", "doc_id")
    words = F.array(*(F.lit(k) for k in RISK_KEYWORDS))
    some = F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 9).cast("int")), " ")
    tail = F.when(F.col("doc_id") % 4 == 0, " http://x a@b").otherwise("")
    return docs.withColumn("text", F.concat("text", F.lit(" "), some, tail))


SEEDED = f"""
seeded AS (
  SELECT doc_id, lang, source,
         text || ' ' || array_to_string(list_slice([{_quoted(RISK_KEYWORDS)}], 1, doc_id % 9), ' ')
         || CASE WHEN doc_id % 4 = 0 THEN ' http://x a@b' ELSE '' END AS text
  FROM documents)"""

HITS = " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in RISK_KEYWORDS)

gazetteer = gazetteer_extractor(GAZETTEER)

_KINDS = "CASE w " + " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in GAZETTEER) + " END"
DOC_ENTITIES = f"""
found AS (
  SELECT doc_id, text, lang, source,
         list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'),
                     lambda w: list_contains([{_quoted(w for w, _ in GAZETTEER)}], w)) AS words
  FROM seeded),
scored AS (
  SELECT doc_id, text, lang, source, words, len(words) AS entity_count,
         10 * ({HITS}) + 5 * len(words) AS risk_score
  FROM found),
enriched AS (
  SELECT *, CASE WHEN risk_score >= 50 THEN 'CRITICAL' WHEN risk_score >= 20 THEN 'HIGH'
                 WHEN risk_score > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label,
         list_transform(words, lambda w: w || '|' || {_KINDS}) AS entities
  FROM scored)"""

RULED = f"""
ruled AS (
  SELECT doc_id, text, lang, source, 10 * ({HITS}) AS risk_score,
         CASE WHEN 10 * ({HITS}) >= 50 THEN 'CRITICAL' WHEN 10 * ({HITS}) >= 20 THEN 'HIGH'
              WHEN 10 * ({HITS}) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label
  FROM seeded)"""


def entity_text(column: str = "entities") -> Column:
    """Entities as one string, for comparison."""
    return F.array_join(F.transform(column, lambda e: F.concat_ws("|", e["text"], e["type"])), ";")


def indexed_docs(spark: SparkSession, sf_dir: str, model_version: str = "risk-rules-v2") -> DataFrame:
    """Seeded documents as index rows keyed by document id; a fixed timestamp per row."""
    docs = seeded_docs(spark, sf_dir).withColumns(
        {
            "id": F.col("doc_id").cast("string"),
            "traceparent": make_traceparent("doc_id"),
            "source_url": F.col("source"),
        }
    )
    return enrich_text(
        docs,
        model_version=model_version,
        now=moment(F.col("doc_id"), "MINUTE"),
        extractor=gazetteer,
        keep=("id",),
    )


INDEXED = f"""{SEEDED},{DOC_ENTITIES},
indexed AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text AS content, words, entities, entity_count,
         risk_score, risk_label, source AS source_url, 'v1' AS schema_version,
         TIMESTAMP '{EPOCH}' + to_minutes(doc_id) AS ts
  FROM enriched)"""


# -- pages ---------------------------------------------------------------------------------------


def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw packets (``page_id, value``); half of them broken in different ways."""
    pages = wide_table(spark, sf_dir, "pages", "page_id")
    kind = F.col("page_id") % 10
    well_formed = pages.select(
        "page_id",
        "url",
        F.col("html").alias("raw_html"),
        F.col("url").alias("source_url"),
        F.date_format(moment(F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_at"),
        make_traceparent("page_id").alias("traceparent"),
    )
    link = F.concat(F.lit('"source_url":"'), F.col("url"), F.lit('"}'))
    value = (
        F.when(kind == 0, F.col("raw_html"))
        .when(kind == 1, F.concat(F.lit('{"raw_html":"   ",'), link))
        .when(kind == 2, F.lit('{"raw_html":"<p>short</p>"}'))
        .when(kind == 3, F.concat(F.lit("{"), link))
        .when(kind == 4, F.concat(F.lit('{"raw_html":5,'), link))
        .otherwise(to_raw_json())
    )
    return well_formed.select("page_id", value.alias("value"))


TRACEPARENT = "'00-' || substr(sha256(CAST({0} AS VARCHAR)), 1, 32) || '-' || substr(sha256(CAST({0} AS VARCHAR)), 33, 16) || '-01'"

ENVELOPES = f"""
envelopes AS (
  SELECT page_id, CASE page_id % 10
    WHEN 0 THEN html
    WHEN 1 THEN '{{"raw_html":"   ","source_url":"' || url || '"}}'
    WHEN 2 THEN '{{"raw_html":"<p>short</p>"}}'
    WHEN 3 THEN '{{"source_url":"' || url || '"}}'
    WHEN 4 THEN '{{"raw_html":5,"source_url":"' || url || '"}}'
    ELSE CAST(to_json({{'raw_html': html, 'source_url': url,
           'collected_at': strftime(TIMESTAMP '{EPOCH}' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ'),
           'traceparent': {TRACEPARENT.format("page_id")}}}) AS VARCHAR) END AS value
  FROM pages),
typed AS (SELECT page_id, value, TRY_CAST(value AS JSON) AS doc FROM envelopes),
parsed AS (
  SELECT page_id, value,
         CASE WHEN json_type(doc, '$.raw_html') = 'VARCHAR' THEN json_extract_string(doc, '$.raw_html') ELSE value END AS html,
         CASE WHEN json_type(doc, '$.traceparent') = 'VARCHAR' THEN json_extract_string(doc, '$.traceparent') END AS traceparent,
         CASE WHEN json_type(doc, '$.source_url') = 'VARCHAR' THEN json_extract_string(doc, '$.source_url') END AS source_url,
         CASE WHEN json_type(doc, '$.collected_at') = 'VARCHAR' THEN json_extract_string(doc, '$.collected_at') END AS collected_at,
         doc IS NULL AS parse_fallback
  FROM typed)"""

# The markup pattern in the syntax of a linear-time matcher (no possessive loops needed there).
_SQL_DROPPED = (
    r"<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
)
_SQL_MARKUP = _SQL_DROPPED + r"""|<[a-z/!?][^>=]*(?:=\s*(?:"[^"]*"|''[^'']*'')?[^>=]*)*(?:>|\z)"""
_SQL_REFERENCE = r"&([a-zA-Z][a-zA-Z0-9]*;|#[0-9]+;|#[xX][0-9a-fA-F]+;)"
SQL_HIDDEN = f"(?is){_SQL_DROPPED}"


def sql_strip(html: str) -> str:
    """SQL for the visible text of an HTML expression, escaped again."""
    out = f"regexp_replace({html}, '(?is){_SQL_MARKUP}', '', 'g')"
    for entity, char in (("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({out}, '{_SQL_REFERENCE}', chr(1) || '\\1', 'g')"
    out = f"replace(replace({out}, '&', '&amp;'), chr(1), '&')"
    return f"replace(replace({out}, '<', '&lt;'), '>', '&gt;')"


def sql_trim(text: str) -> str:
    return f"trim({text}, '{WHITE_SPACE}')"


CLASSIFIED = f"""{ENVELOPES},
stripped AS (
  SELECT *, {sql_trim("html")} = '' AS blank, {sql_trim(sql_strip("html"))} AS clean FROM parsed),
classified AS (
  SELECT *, CASE WHEN blank THEN 'dlq' WHEN strlen(clean) < 80 THEN 'dropped' ELSE 'ok' END AS outcome
  FROM stripped)"""

# -- conversations -------------------------------------------------------------------------------


def conversation_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sanitized packets (``conv_id, turn, value``), some plain, some malformed."""
    turns = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 11
    packet = F.to_json(
        F.struct(
            F.col("text"),
            F.concat(F.lit("https://chat.example/"), F.col("conv_id").cast("string")).alias("source_url"),
            make_traceparent(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias(
                "traceparent"
            ),
        )
    )
    value = (
        F.when(kind.isin(0, 6), F.col("text"))
        .when(kind == 3, F.lit('{"text": 5}'))
        .when(kind == 5, F.lit("[1]"))
        .when(kind == 7, F.lit('{"text": "", "source_url": "https://chat.example/"}'))
        # plain text that only starts like JSON
        .when(kind == 8, F.concat(F.lit("7 "), F.col("text")))
        .when(kind == 9, F.concat(F.lit("[1] "), F.col("text")))
        .otherwise(packet)
    )
    return turns.select("conv_id", "turn", value.alias("value"))


_TURN_KEY = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"
PACKETS = f"""
packets AS (
  SELECT conv_id, turn, text AS original, (conv_id + turn) % 11 AS kind,
         CASE WHEN (conv_id + turn) % 11 IN (0, 6) THEN text
              WHEN (conv_id + turn) % 11 = 3 THEN '{{"text": 5}}'
              WHEN (conv_id + turn) % 11 = 5 THEN '[1]'
              WHEN (conv_id + turn) % 11 = 7 THEN '{{"text": "", "source_url": "https://chat.example/"}}'
              WHEN (conv_id + turn) % 11 = 8 THEN '7 ' || text
              WHEN (conv_id + turn) % 11 = 9 THEN '[1] ' || text
              ELSE CAST(to_json({{'text': text, 'source_url': 'https://chat.example/' || CAST(conv_id AS VARCHAR),
                    'traceparent': {TRACEPARENT.format(_TURN_KEY)}}}) AS VARCHAR) END AS value
  FROM conversations),
packet_docs AS (SELECT *, TRY_CAST(value AS JSON) AS doc FROM packets),
parsed_packets AS (
  SELECT conv_id, turn, value, doc IS NULL AS fallback,
         CASE WHEN doc IS NOT NULL AND json_type(doc) <> 'OBJECT' THEN 'non_object_json'
              WHEN json_type(doc, '$.text') NOT IN ('VARCHAR', 'NULL') THEN 'non_string_text' END AS quarantine,
         CASE WHEN json_type(doc, '$.text') = 'VARCHAR' AND json_extract_string(doc, '$.text') <> ''
              THEN json_extract_string(doc, '$.text') ELSE value END AS found_text,
         json_extract_string(doc, '$.traceparent') AS traceparent,
         json_extract_string(doc, '$.source_url') AS source_url
  FROM packet_docs)"""

# -- events --------------------------------------------------------------------------------------


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as counters read every minute: a running count per deployment that restarts daily."""
    events = table(spark, sf_dir, "events")
    counted = events.groupBy(
        F.concat(F.lit("deploy-"), (F.col("user_id") % 2).cast("string")).alias("job"),
        F.when(F.col("event_type") == "error", "brain_index_failures_total").otherwise("brain_processed_total").alias("metric"),
        F.date_trunc("minute", "ts").alias("ts"),
    ).agg(F.count(F.lit(1)).alias("n"))
    # at most one row per minute of the day
    daily = Window.partitionBy("job", "metric", F.date_trunc("day", "ts")).orderBy("ts")
    return counted.select("job", "metric", "ts", F.sum("n").over(daily).cast("double").alias("value"))


SAMPLES = """
minutes AS (
  SELECT 'deploy-' || CAST(user_id % 2 AS VARCHAR) AS job,
         CASE WHEN event_type = 'error' THEN 'brain_index_failures_total' ELSE 'brain_processed_total' END AS metric,
         date_trunc('minute', ts) AS ts, count(*) AS n
  FROM events GROUP BY ALL),
samples AS (
  SELECT job, metric, ts, CAST(sum(n) OVER (PARTITION BY job, metric, date_trunc('day', ts) ORDER BY ts) AS DOUBLE) AS value
  FROM minutes),
stepped AS (
  SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start,
         lag(value) OVER (PARTITION BY job, metric ORDER BY ts, value) AS previous FROM samples),
rates AS (
  SELECT job, metric, window_start, count(*) AS samples,
         sum(CASE WHEN previous IS NULL THEN 0 WHEN value < previous THEN value ELSE value - previous END) AS increase
  FROM stepped GROUP BY ALL)"""


def event_outcomes(spark: SparkSession, sf_dir: str, deployments: int = 50) -> DataFrame:
    """Events as outcomes of that many deployments."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % deployments).alias("deployment"), "ts", (F.col("event_type") == "error").alias("failed")
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gateway requests of three services, with two checks each."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("service-"), (F.col("user_id") % 3).cast("string")).alias("service"),
        "ts",
        F.abs("value").alias("latency_ms"),
        failed.alias("failed"),
        F.lit(2).alias("checks"),
        ((~failed).cast("int") + F.contains("props", F.lit("k")).cast("int")).alias("checks_passed"),
    )


REQUESTS = """
requests AS (
  SELECT 'service-' || CAST(user_id % 3 AS VARCHAR) AS service, ts, abs(value) AS latency_ms,
         event_type = 'error' AS failed,
         CAST(event_type <> 'error' AS INT) + CAST(contains(props, 'k') AS INT) AS checks_passed
  FROM events)"""
