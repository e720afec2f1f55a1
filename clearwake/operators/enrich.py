"""Sanitized packets to scored index rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_packet_with_meta
from clearwake.functions.risk import label_to_score, risk_label, risk_score
from clearwake.functions.staging import pin
from clearwake.functions.text import RISK_KEYWORDS, truncate
from clearwake.operators.entities import Extractor, blank_extractor

# The version stamps used when a caller gives none.
SCHEMA_VERSION = "v1"
MODEL_VERSION = "risk-rules-v2"

STRATEGIES = ("rules", "ml", "auto")

INDEX_COLUMNS = (
    "content",
    "entities",
    "entity_count",
    "risk_score",
    "risk_label",
    "traceparent",
    "source_url",
    "schema_version",
    "model_version",
    "timestamp",
)


class Enriched(NamedTuple):
    ok: DataFrame
    dlq: DataFrame


def score_rules(df: DataFrame, text: str = "text", keywords: Sequence[str] = RISK_KEYWORDS) -> DataFrame:
    """Adds ``risk_score`` and ``risk_label`` from keyword and entity counts."""
    scored = pin(df.withColumn("risk_score", risk_score(text, "entities", keywords)), "risk_score")
    return scored.withColumn("risk_label", risk_label("risk_score"))


def score(df: DataFrame, strategy: str = "rules", model=None, text: str = "text") -> DataFrame:
    """Adds ``risk_score`` and ``risk_label``.

    ``rules`` ignores the model. ``ml`` and ``auto`` use it where there is one; without a model,
    and for a row it gives no label, the rules decide. A model is anything with
    ``transform(df)`` that adds ``ml_label``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    ruled = score_rules(df, text)
    if strategy == "rules" or model is None:
        return ruled
    predicted = model.transform(ruled)
    has_label = F.col("ml_label").isNotNull()
    return (
        predicted.withColumn(
            "risk_score", F.when(has_label, label_to_score("ml_label")).otherwise(F.col("risk_score"))
        )
        .withColumn("risk_label", F.coalesce("ml_label", "risk_label"))
        .select(*ruled.columns)
    )


def stamp(
    df: DataFrame, schema_version: str, model_version: str, now: datetime | Column | None = None
) -> DataFrame:
    """Adds the version columns and the UTC timestamp (the query's start unless given)."""
    if now is None:
        now = F.current_timestamp()
    moment = now if isinstance(now, Column) else F.lit(now)
    return (
        df.withColumn("schema_version", F.lit(schema_version))
        .withColumn("model_version", F.lit(model_version))
        .withColumn("timestamp", moment.cast("timestamp"))
    )


def enrich_text(
    df: DataFrame,
    *,
    model_version: str,
    schema_version: str = SCHEMA_VERSION,
    now: datetime | Column | None = None,
    extractor: Extractor = blank_extractor,
    strategy: str = "rules",
    model=None,
    text: str = "text",
    content_chars: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows with a ``text`` to index rows. Scores the whole text, stores its start."""
    scored = score(extractor(df, text), strategy, model, text)
    stamped = stamp(scored, schema_version, model_version, now)
    out = stamped.withColumn("content", truncate(text, content_chars) if content_chars else F.col(text) if isinstance(text, str) else text).withColumn(
        "entity_count", F.size("entities")
    )
    for meta in ("traceparent", "source_url"):
        if meta not in out.columns:
            out = out.withColumn(meta, F.lit(None).cast("string"))
    return out.select(*keep, *INDEX_COLUMNS)


def enrich(df: DataFrame, *, value: str = "value", id_column: str | None = None, **options) -> Enriched:
    """Sanitized packets to index rows (keyed by ``id``) and quarantined dead letters.

    Without an ``id_column`` a packet is keyed by its content, so two deliveries have one key; rows of
    equal keys are merged by who stores them. ``options`` are those of ``enrich_text``; ``model_version`` is required.
    """
    parsed = parse_packet_with_meta(df, value)
    key = F.sha2(value, 256) if id_column is None else F.col(id_column).cast("string")
    keyed = parsed.withColumn("id", key)
    keep = ("id", *options.pop("keep", ()))
    ok = enrich_text(keyed.where("quarantine IS NULL"), keep=keep, **options)
    now = options.get("now")
    failed_at = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    dlq = keyed.where("quarantine IS NOT NULL").select(
        F.col("quarantine").alias("error"),
        F.col(value).alias("payload"),
        failed_at.cast("timestamp").alias("failed_at"),
        "traceparent",
        "source_url",
    )
    return Enriched(ok, dlq)


def span_attributes(
    enriched: DataFrame, queue: str = "sanitized_text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One span record per packet: queue, length, fallback flag, URL, score and label.

    Expects ``text``, ``fallback``, ``risk_score``, ``risk_label`` and the trace columns.
    """
    return enriched.select(
        *keep,
        F.lit("process_packet").alias("span"),
        "traceparent",
        F.lit(queue).alias("queue_name"),
        F.length("text").alias("packet_length"),
        F.col("fallback").alias("packet_fallback"),
        F.nullif("source_url", F.lit("")).alias("source_url"),
        "risk_score",
        "risk_label",
    )
