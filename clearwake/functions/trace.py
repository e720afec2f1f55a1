"""W3C trace context strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearwake.functions.text import col_of

_FORM = r"^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
ZERO_TRACE = "0" * 32
ZERO_SPAN = "0" * 16


def make_traceparent(key: Column | str, sampled: bool | Column = True) -> Column:
    """Trace context derived from a row key, so a rerun gives a row the same one.

    A null key (no identity to derive from) gets the all-zero context.
    """
    digest = F.sha2(col_of(key).cast("string"), 256)
    flags = F.when(sampled, "01").otherwise("00") if isinstance(sampled, Column) else F.lit("01" if sampled else "00")
    trace_id = F.coalesce(F.substring(digest, 1, 32), F.lit(ZERO_TRACE))
    span_id = F.coalesce(F.substring(digest, 33, 16), F.lit(ZERO_SPAN))
    return F.concat_ws("-", F.lit("00"), trace_id, span_id, flags)


def random_traceparent(sampled: bool = True) -> Column:
    """Trace context from random ids; differs on every evaluation, so store it before use."""
    return make_traceparent(F.uuid(), sampled)


def parse_traceparent(value: Column | str) -> Column:
    """struct(version, trace_id, span_id, flags, valid); all-zero ids are not valid."""
    text = col_of(value)

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, _FORM, i), F.lit(""))

    trace_id, span_id = part(2), part(3)
    valid = (
        trace_id.isNotNull()
        & (trace_id != ZERO_TRACE)
        & (span_id != ZERO_SPAN)
        & (part(1) != "ff")
    )
    return F.struct(
        part(1).alias("version"),
        trace_id.alias("trace_id"),
        span_id.alias("span_id"),
        part(4).alias("flags"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def valid_trace_id(value: Column | str) -> Column:
    """The trace id of a valid context, else null."""
    parsed = parse_traceparent(value)
    return F.when(parsed["valid"], parsed["trace_id"])
