"""Dead letters: one schema for every producer, and bounded oldest-first replay."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.packets import text_field, with_document
from clearwake.schemas import DLQ

REPLAY_COUNT = 50


class Replay(NamedTuple):
    replayed: DataFrame
    remaining: DataFrame


def _aligned(df: DataFrame, stage: str | None, keep: tuple[str, ...]) -> DataFrame:
    have = set(df.columns)

    def either(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None)

    source = {
        "stage": F.lit(stage) if stage is not None else either("stage"),
        "payload": either("payload", "raw_payload"),
    }
    return df.select(
        *keep,
        *(
            source.get(f.name, either(f.name)).cast(f.dataType).alias(f.name)
            for f in DLQ.fields
        ),
    )


def normalise_dlq(df: DataFrame, stage: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dead letters with any of the produced column sets, in the one DLQ schema.

    ``payload`` and ``raw_payload`` are the same thing; ``failed_at``, ``failed_queue`` and the
    trace columns are null where a producer does not write them.
    """
    return _aligned(df, stage, keep)


def parse_dlq(df: DataFrame, stage: str | None, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Dead letters that still are JSON strings, in the one DLQ schema.

    Without a ``stage`` the column of that name is used.
    """
    names = ("error", "payload", "raw_payload", "failed_queue", "failed_at", "traceparent", "source_url")
    doc = with_document(df, value, names)
    held = keep if stage is not None else (*keep, "stage")
    fields = doc.select(*held, *(text_field(n).alias(n) for n in names))
    return _aligned(fields.withColumn("failed_at", F.try_to_timestamp("failed_at")), stage, keep)


def to_envelope() -> Column:
    """The JSON a replay without unwrapping re-feeds: the dead letter itself."""
    return F.to_json(
        F.struct("error", "payload", F.col("failed_at").cast("string").alias("failed_at"), "traceparent", "source_url"),
        {"ignoreNullFields": "false"},
    )


def replay(
    dlq: DataFrame, count: int = REPLAY_COUNT, unwrap: bool = True, key: str = "id"
) -> Replay:
    """The ``count`` oldest dead letters as packets (``key``, ``value``), and the rest as dead letters.

    Letters without a time come first, ties go by ``key``, which must be unique. With ``unwrap``
    the original payload is fed again; without, the dead letter as it is. The rest is found by
    comparing with the last replayed letter, so the queue is not joined with itself.
    """
    if count <= 0:
        raise ValueError("count must be greater than zero")
    known = F.col("failed_at").isNotNull()
    order = F.struct(known.alias("known"), F.col("failed_at"), F.col(key).alias("key"))
    first = dlq.orderBy(known, F.col("failed_at"), F.col(key)).limit(count)
    value = F.col("payload") if unwrap else to_envelope()
    last = first.agg(F.max(order).alias("last")).scalar()
    return Replay(first.select(key, value.alias("value")), dlq.where(order > last))
