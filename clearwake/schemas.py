"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField("text", T.StringType()), T.StructField("type", T.StringType())])
ENTITIES = T.ArrayType(ENTITY)

RAW_HTML = T.StructType(
    [
        T.StructField("raw_html", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("collected_at", T.StringType()),
        T.StructField("traceparent", T.StringType()),
    ]
)

SANITIZED_TEXT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("traceparent", T.StringType()),
    ]
)

# ``id`` is the row key of the versioned table; the other ten columns are the strict mapping.
INDEX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("entities", ENTITIES),
        T.StructField("entity_count", T.IntegerType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("risk_label", T.StringType()),
        T.StructField("traceparent", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

DLQ = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("failed_queue", T.StringType()),
        T.StructField("failed_at", T.TimestampType()),
        T.StructField("traceparent", T.StringType()),
        T.StructField("source_url", T.StringType()),
    ]
)

CASES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("entities", ENTITIES),
        T.StructField("expected_label", T.StringType()),
    ]
)

SAMPLES = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

_RATE = T.StructType([T.StructField("values", T.StructType([T.StructField("rate", T.DoubleType())]))])
LOAD_SUMMARY = T.StructType(
    [
        T.StructField(
            "metrics",
            T.StructType([T.StructField("http_req_failed", _RATE), T.StructField("checks", _RATE)]),
        )
    ]
)

USERS = T.StructType(
    [
        T.StructField(
            "users",
            T.ArrayType(
                T.StructType(
                    [T.StructField("username", T.StringType()), T.StructField("role", T.StringType())]
                )
            ),
        )
    ]
)


class SchemaMismatch(ValueError):
    """A DataFrame does not have exactly the columns of a strict table."""


def require_exact(found: T.StructType, wanted: T.StructType) -> None:
    """Reject unknown, missing or differently typed columns (order and nullability are free)."""

    def shape(schema: T.StructType) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in schema.fields}

    have, want = shape(found), shape(wanted)
    if have != want:
        unknown = sorted(set(have) - set(want))
        missing = sorted(set(want) - set(have))
        typed = sorted(c for c in set(have) & set(want) if have[c] != want[c])
        raise SchemaMismatch(f"unknown={unknown} missing={missing} type differs={typed}")
