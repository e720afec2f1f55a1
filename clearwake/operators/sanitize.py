"""Raw page packets to clean text, with a quality guard and a dead-letter branch."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_raw_packet
from clearwake.functions.staging import pin
from clearwake.functions.text import is_blank, strip_html, trim_white

MIN_TEXT_BYTES = 50
EMPTY_HTML = "empty_raw_html"


class Sanitized(NamedTuple):
    ok: DataFrame
    dlq: DataFrame
    dropped: DataFrame


def min_length(df: DataFrame, column: str, min_bytes: int = MIN_TEXT_BYTES) -> DataFrame:
    """Keep rows whose trimmed text has at least ``min_bytes`` UTF-8 bytes."""
    return df.where(F.octet_length(trim_white(column)) >= min_bytes)


def classify_raw(df: DataFrame, min_bytes: int = MIN_TEXT_BYTES, value: str = "value") -> DataFrame:
    """Every packet with ``text``, ``length`` (bytes of its HTML), ``outcome`` and ``error``.

    ``outcome`` is ``ok``, ``dlq`` (blank HTML) or ``dropped`` (too little text). Markup is only
    removed where the HTML is not blank. No shuffle: one projection over the input.
    """
    parsed = parse_raw_packet(df, value)
    blank = is_blank("html")
    cleaned = parsed.withColumn("_blank", blank).withColumn(
        "text", F.when(~F.col("_blank"), trim_white(strip_html("html")))
    )
    outcome = (
        F.when(F.col("_blank"), "dlq")
        .when(F.octet_length("text") < min_bytes, "dropped")
        .otherwise("ok")
    )
    judged = cleaned.withColumns(
        {
            "outcome": outcome,
            "error": F.when(F.col("_blank"), EMPTY_HTML),
            "length": F.octet_length("html").cast("long"),
        }
    )
    return pin(judged.drop("_blank"), "text", "outcome", "error", "length")


def sanitize(
    df: DataFrame, min_bytes: int = MIN_TEXT_BYTES, value: str = "value", keep: tuple[str, ...] = ()
) -> Sanitized:
    """Split classified packets into clean text, dead letters and silent drops.

    ``keep`` names input columns to carry along. A caller that writes more than one branch
    should persist ``classify_raw`` and call ``split`` instead, so that packets are parsed once.
    """
    return split(classify_raw(df, min_bytes, value), value, keep)


def split(classified: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> Sanitized:
    ok = classified.where("outcome = 'ok'").select(*keep, "text", "length", "source_url", "traceparent")
    dlq = classified.where("outcome = 'dlq'").select(*keep, "error", F.col(value).alias("raw_payload"))
    dropped = classified.where("outcome = 'dropped'").select(*keep, F.col(value).alias("raw_payload"))
    return Sanitized(ok, dlq, dropped)
