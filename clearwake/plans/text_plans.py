"""Packets, cleaning, scoring and entities over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_packet_with_meta, parse_raw_packet, strict_json
from clearwake.functions.risk import FEATURES, LABEL_SCORES, featurize, label_to_score
from clearwake.functions.text import enriched_text, is_blank, keyword_hits, strip_html, trim_white, truncate
from clearwake.functions.trace import make_traceparent, parse_traceparent
from clearwake.operators.enrich import enrich_text, score, score_rules, span_attributes
from clearwake.operators.entities import blank_extractor, gazetteer_join
from clearwake.operators.sanitize import classify_raw, min_length
from clearwake.plans.inputs import (
    CLASSIFIED,
    DOC_ENTITIES,
    ENVELOPES,
    GAZETTEER,
    HITS,
    INDEXED,
    PACKETS,
    RULED,
    SEEDED,
    TRACEPARENT,
    conversation_packets,
    entity_text,
    gazetteer,
    indexed_docs,
    moment,
    raw_envelopes,
    seeded_docs,
    sql_strip,
    sql_trim,
)
from clearwake.plans.registry import query, table, wide_table

PAGE_MIN_BYTES = 80


@query(
    "scan_raw",
    f"""WITH {ENVELOPES}
SELECT page_id, TRY_CAST(value AS JSON) IS NOT NULL AS is_json,
       CASE WHEN page_id % 10 < 5 THEN strlen(value) END AS plain_bytes FROM envelopes""",
)
def scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw envelopes, one per page; serialised ones may differ in escapes, so only their form is compared."""
    return raw_envelopes(spark, sf_dir).select(
        "page_id",
        strict_json("value").isNotNull().alias("is_json"),
        F.when(F.col("page_id") % 10 < 5, F.octet_length("value").cast("long")).alias("plain_bytes"),
    )


@query(
    "parse_raw",
    f"""WITH {ENVELOPES}
SELECT page_id, md5(html) AS html_md5, strlen(html) AS html_bytes, traceparent, source_url, parse_fallback FROM parsed""",
)
def parse_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_raw_packet(raw_envelopes(spark, sf_dir)).select(
        "page_id",
        F.md5("html").alias("html_md5"),
        F.octet_length("html").cast("long").alias("html_bytes"),
        "traceparent",
        "source_url",
        "parse_fallback",
    )


@query(
    "parse_sanitized",
    f"""WITH {PACKETS}
SELECT conv_id, turn, CASE WHEN quarantine IS NULL THEN md5(found_text) END AS text_md5,
       traceparent, source_url, fallback, quarantine FROM parsed_packets""",
)
def parse_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_packet_with_meta(conversation_packets(spark, sf_dir)).select(
        "conv_id", "turn", F.md5("text").alias("text_md5"), "traceparent", "source_url", "fallback", "quarantine"
    )


@query("blank_html", f"WITH {ENVELOPES} SELECT page_id, {sql_trim('html')} = '' AS blank FROM parsed")
def blank_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_raw_packet(raw_envelopes(spark, sf_dir)).select("page_id", is_blank("html").alias("blank"))


@query("strip_html", f"SELECT page_id, {sql_strip('html')} AS text FROM pages")
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_table(spark, sf_dir, "pages", "page_id").select("page_id", strip_html("html").alias("text"))


@query(
    "min_length",
    f"SELECT doc_id, strlen({sql_trim('text')}) AS trimmed_bytes FROM documents WHERE strlen({sql_trim('text')}) >= 500",
)
def min_length_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_length(wide_table(spark, sf_dir, "documents", "doc_id"), "text", 500).select(
        "doc_id", F.octet_length(trim_white("text")).cast("long").alias("trimmed_bytes")
    )


@query(
    "sanitize_pages",
    f"""WITH {CLASSIFIED}
SELECT page_id, outcome, CASE WHEN NOT blank THEN md5(clean) END AS text_md5, strlen(html) AS length,
       source_url, traceparent, CASE WHEN blank THEN 'empty_raw_html' END AS error FROM classified""",
)
def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sanitizing stage: every packet, its clean text and its outcome."""
    return classify_raw(raw_envelopes(spark, sf_dir), PAGE_MIN_BYTES).select(
        "page_id", "outcome", F.md5("text").alias("text_md5"), "length", "source_url", "traceparent", "error"
    )


@query("truncate_content", "SELECT doc_id, md5(substr(text, 1, 5000)) AS content_md5 FROM documents")
def truncate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(truncate("text")).alias("content_md5"))


@query("keyword_hits", f"WITH {SEEDED} SELECT doc_id, {HITS} AS hits FROM seeded")
def keyword_hits_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_docs(spark, sf_dir).select("doc_id", keyword_hits("text").alias("hits"))


@query("risk_rules", f"WITH {SEEDED}, {RULED} SELECT doc_id, risk_score, risk_label FROM ruled")
def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(blank_extractor(seeded_docs(spark, sf_dir))).select("doc_id", "risk_score", "risk_label")


@query(
    "risk_features",
    f"""WITH {SEEDED}, {DOC_ENTITIES}
SELECT doc_id, {HITS} AS keyword_hits, entity_count, length(text) AS char_length,
       CAST((length(text) - length(replace(lower(text), 'http', ''))) / 4 AS INT) AS http_count,
       length(text) - length(replace(text, '@', '')) AS at_count FROM enriched""",
)
def risk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gazetteer(seeded_docs(spark, sf_dir))
    return found.withColumns(featurize("text", "entities")).select("doc_id", *FEATURES)


_SCORES = " ".join(f"WHEN '{label}' THEN {value}" for label, value in LABEL_SCORES.items())


@query(
    "label_score_map",
    f"""WITH {SEEDED}, {RULED}
SELECT doc_id, risk_label, CASE CASE WHEN doc_id % 10 = 0 THEN 'UNKNOWN' ELSE risk_label END {_SCORES} ELSE 0 END AS score FROM ruled""",
)
def label_score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = score_rules(blank_extractor(seeded_docs(spark, sf_dir)))
    label = F.when(F.col("doc_id") % 10 == 0, "UNKNOWN").otherwise(F.col("risk_label"))
    return ruled.select("doc_id", "risk_label", label_to_score(label).alias("score"))


class _LengthModel:
    """Stand-in model: a label for long texts, none for short ones."""

    @staticmethod
    def transform(df: DataFrame) -> DataFrame:
        return df.withColumn("ml_label", F.when(F.length("text") > 1000, "HIGH"))


@query(
    "score_auto",
    f"""WITH {SEEDED}, {RULED}
SELECT doc_id, CASE WHEN length(text) > 1000 THEN 30 ELSE risk_score END AS risk_score,
       CASE WHEN length(text) > 1000 THEN 'HIGH' ELSE risk_label END AS risk_label FROM ruled""",
)
def score_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model labels where the model gives one, rules elsewhere."""
    scored = score(blank_extractor(seeded_docs(spark, sf_dir)), "auto", _LengthModel)
    return scored.select("doc_id", "risk_score", "risk_label")


_ENTITY_SQL = f"""WITH {SEEDED}, {DOC_ENTITIES}
SELECT doc_id, entity_count, array_to_string(entities, ';') AS entities FROM enriched"""


@query("entity_gazetteer", _ENTITY_SQL)
def entity_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer(seeded_docs(spark, sf_dir)).select(
        "doc_id", F.size("entities").alias("entity_count"), entity_text().alias("entities")
    )


@query("entity_gazetteer_table", _ENTITY_SQL)
def entity_gazetteer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the dictionary as a table."""
    rows = F.array(*(F.struct(F.lit(w).alias("phrase"), F.lit(t).alias("type")) for w, t in GAZETTEER))
    words = spark.range(1).select(F.inline(rows))
    found = gazetteer_join(seeded_docs(spark, sf_dir), words, "doc_id", max_words=1)
    return found.select("doc_id", F.size("entities").alias("entity_count"), entity_text().alias("entities"))


@query(
    "enrich_docs",
    f"""WITH {INDEXED}
SELECT id, md5(content) AS content_md5, array_to_string(entities, ';') AS entities, entity_count, risk_score, risk_label,
       {TRACEPARENT.format("doc_id")} AS traceparent, source_url, schema_version, 'risk-rules-v2' AS model_version,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM indexed""",
)
def enrich_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents to scored index rows."""
    return indexed_docs(spark, sf_dir).select(
        "id",
        F.md5("content").alias("content_md5"),
        entity_text().alias("entities"),
        "entity_count",
        "risk_score",
        "risk_label",
        "traceparent",
        "source_url",
        "schema_version",
        "model_version",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


@query(
    "enrich_pages",
    f"""WITH {CLASSIFIED},
hits AS (SELECT page_id, clean AS text, source_url, traceparent FROM classified WHERE outcome = 'ok')
SELECT page_id, 10 * ({HITS}) AS risk_score,
       CASE WHEN 10 * ({HITS}) >= 50 THEN 'CRITICAL' WHEN 10 * ({HITS}) >= 20 THEN 'HIGH'
            WHEN 10 * ({HITS}) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label,
       md5(text) AS content_md5, source_url, traceparent FROM hits""",
)
def enrich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages in one plan: raw packet to index row without a shuffle."""
    ok = classify_raw(raw_envelopes(spark, sf_dir), PAGE_MIN_BYTES).where("outcome = 'ok'")
    rows = enrich_text(ok, model_version="risk-rules-v2", now=moment(F.col("page_id")), keep=("page_id",))
    return rows.select(
        "page_id", "risk_score", "risk_label", F.md5("content").alias("content_md5"), "source_url", "traceparent"
    )


@query("traceparent", f"SELECT doc_id, {TRACEPARENT.format('doc_id')} AS traceparent FROM documents")
def traceparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", make_traceparent("doc_id").alias("traceparent"))


@query(
    "traceparent_parse",
    f"""WITH made AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '00-abc-def-01'
   WHEN 1 THEN '00-00000000000000000000000000000000-' || substr(sha256(CAST(doc_id AS VARCHAR)), 33, 16) || '-01'
   WHEN 2 THEN NULL ELSE {TRACEPARENT.format("doc_id")} END AS tp FROM documents)
SELECT doc_id, CASE WHEN length(tp) = 55 THEN split_part(tp, '-', 2) END AS trace_id,
       CASE WHEN length(tp) = 55 THEN split_part(tp, '-', 3) END AS span_id,
       CASE WHEN length(tp) = 55 THEN split_part(tp, '-', 4) END AS flags,
       coalesce(length(tp) = 55 AND split_part(tp, '-', 2) <> repeat('0', 32), false) AS valid FROM made""",
)
def traceparent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, kind = make_traceparent("doc_id"), F.col("doc_id") % 5
    value = (
        F.when(kind == 0, "00-abc-def-01")
        .when(kind == 1, F.concat(F.lit("00-" + "0" * 32), F.substring(made, 36, 20)))
        .when(kind != 2, made)
    )
    parts = table(spark, sf_dir, "documents").select("doc_id", parse_traceparent(value).alias("p"))
    return parts.select("doc_id", "p.trace_id", "p.span_id", "p.flags", "p.valid")


@query(
    "span_rows",
    f"""WITH {PACKETS}, spans AS (SELECT *, found_text AS text FROM parsed_packets WHERE quarantine IS NULL)
SELECT conv_id, turn, traceparent, length(text) AS packet_length, fallback AS packet_fallback, source_url,
       10 * ({HITS}) AS risk_score FROM spans""",
)
def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_packet_with_meta(conversation_packets(spark, sf_dir)).where("quarantine IS NULL")
    scored = score_rules(blank_extractor(parsed))
    spans = span_attributes(scored, keep=("conv_id", "turn"))
    return spans.drop("span", "queue_name", "risk_label")


@query(
    "enriched_text",
    f"""WITH {SEEDED}, {DOC_ENTITIES}
SELECT doc_id, md5(text || ' __entity_count_' || CAST(entity_count AS VARCHAR) || '__') AS text_md5 FROM enriched""",
)
def enriched_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gazetteer(seeded_docs(spark, sf_dir))
    return found.select("doc_id", F.md5(enriched_text("text", "entities")).alias("text_md5"))
