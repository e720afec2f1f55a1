"""Tolerant reading of JSON packets: anything that is not JSON is taken as plain text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.staging import pin
from clearwake.functions.text import col_of

# A VARIANT holds at most 16 MiB. Longer packets are read a second time with fixed schemas,
# starting well below the limit because a variant can be longer than its JSON text.
_OVERSIZE_BYTES = 4 * 1024 * 1024
_STRICT_JSON = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxStringLen": str(2**31 - 1),
}


def _in_array(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


def _one_object_member(text: Column) -> Column:
    members = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(F.size(members) == 1, F.lit(False))


def strict_json(text: Column | str) -> Column:
    """The text as a VARIANT if all of it is one JSON value, else null.

    Spark's JSON functions stop after the first value and ignore what follows, so ``7 days`` would
    pass as a number. As an array element and as an object member alike, only a single whole value
    has nothing left over. The member check only scans; single quotes are refused by the other.
    """
    value = col_of(text)
    parsed = F.try_variant_get(F.try_parse_json(_in_array(value)), "$[0]", "variant")
    return F.when(_one_object_member(value), parsed)


def _type_of(doc: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))


def string_field(doc: Column, field: str) -> Column:
    """The field if it is a JSON string, else null (numbers are not converted)."""
    return F.when(_type_of(doc, field) == "STRING", F.try_variant_get(doc, f"$.{field}", "string"))


#: The kinds of value other than strings. Read as one kind, a field of any other kind is null.
_KINDS = {"number": "DOUBLE", "flag": "BOOLEAN", "list": "ARRAY<STRING>", "object": "MAP<STRING,STRING>"}


def _big_fields(raw: Column, fields: tuple[str, ...]) -> Column:
    """Per field of an oversize object: ``text`` (null for JSON null), ``is_text``, and ``empty`` for a
    non-string value that is zero, false or has no elements."""

    def read(kind: str) -> Column:
        return F.from_json(raw, ", ".join(f"{f} {kind}" for f in fields), _STRICT_JSON)

    def field(name: str, text: Column, *others: Column) -> Column:
        number, flag, listed, mapped = (o.getField(name) for o in others)
        other = number.isNotNull() | flag.isNotNull() | listed.isNotNull() | mapped.isNotNull()
        empty = (number == 0.0, ~flag, F.size(listed) == 0, F.size(mapped) == 0)
        return F.struct(
            text.getField(name).alias("text"),
            (text.getField(name).isNotNull() & ~other).alias("is_text"),
            reduce(or_, (F.coalesce(e, F.lit(False)) for e in empty)).alias("empty"),
        ).alias(name)

    parsed = [read(kind) for kind in ("STRING", *_KINDS.values())]
    return F.struct(*(field(f, *parsed) for f in fields))


def with_document(df: DataFrame, value: str, fields: tuple[str, ...]) -> DataFrame:
    """Adds ``_doc`` (VARIANT), ``_big`` (the ``fields`` of an oversize object) and ``_json``, whether it is JSON."""
    raw = F.col(value)
    doc = df.withColumn("_doc", strict_json(raw))
    oversize = F.col("_doc").isNull() & (F.octet_length(raw) > _OVERSIZE_BYTES)
    whole = (F.json_array_length(_in_array(raw)) == 1) & _one_object_member(raw)
    # a value of any kind is read here as a member, which finds faults in all of it
    member = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v STRING, _corrupt STRING", _STRICT_JSON)
    big = F.coalesce(oversize & whole & member.getField("_corrupt").isNull(), F.lit(False))
    doc = doc.withColumn("_big_json", big)
    is_object = F.col("_big_json") & F.json_object_keys(raw).isNotNull()
    return (
        doc.withColumn("_big", F.when(is_object, _big_fields(raw, fields)))
        .withColumn("_json", F.col("_doc").isNotNull() | F.col("_big_json"))
        .drop("_big_json")
    )


def text_field(field: str) -> Column:
    """A string field of what ``with_document`` read, else null."""
    return F.coalesce(
        string_field(F.col("_doc"), field), F.when(F.col(f"_big.{field}.is_text"), F.col(f"_big.{field}.text"))
    )


def parse_raw_packet(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``html, traceparent, source_url, parse_fallback`` to raw page packets.

    Invalid JSON: the whole value is HTML and ``parse_fallback`` is true. Valid JSON without a
    *string* ``raw_html``: the whole value again, but not a fallback.
    """
    fields = ("raw_html", "traceparent", "source_url", "collected_at")
    parsed = with_document(df, value, fields)
    read = parsed.withColumns(
        {
            "html": F.coalesce(text_field("raw_html"), F.col(value)),
            "traceparent": text_field("traceparent"),
            "source_url": text_field("source_url"),
            "collected_at": text_field("collected_at"),
            "parse_fallback": ~F.col("_json"),
        }
    )
    added = ("html", "traceparent", "source_url", "collected_at", "parse_fallback")
    return pin(read.drop("_doc", "_big", "_json"), *added)


def _empty_json_value(doc: Column) -> Column:
    """Whether a non-string ``text`` counts as absent: null, false, zero, empty list or object."""
    found = F.try_variant_get(doc, "$.text", "variant")
    kind = F.schema_of_variant(found)
    off = (kind == "BOOLEAN") & (F.try_variant_get(doc, "$.text", "boolean") == F.lit(False))
    zero = ~kind.isin("BOOLEAN", "STRING") & (F.try_variant_get(doc, "$.text", "double") == 0.0)
    hollow = (kind != "STRING") & F.to_json(found).isin("[]", "{}")
    absent = found.isNull() | (kind == "VOID")
    return reduce(or_, (F.coalesce(c, F.lit(False)) for c in (absent, off, zero, hollow)))


def parse_packet_with_meta(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``text, traceparent, source_url, fallback, quarantine`` to sanitized packets.

    A missing or empty ``text`` yields the whole packet, and that is not a fallback. JSON that
    is not an object, or a ``text`` that is neither a string nor empty, has no text:
    ``quarantine`` holds the reason.
    """
    parsed = with_document(df, value, ("text", "traceparent", "source_url"))
    doc, raw = F.col("_doc"), F.col(value)
    is_object = F.col("_big").isNotNull() | F.schema_of_variant(doc).startswith("OBJECT")
    text = F.nullif(text_field("text"), F.lit(""))
    big = F.col("_big.text")
    bad_small = (_type_of(doc, "text") != "STRING") & ~_empty_json_value(doc)
    bad_big = big["text"].isNotNull() & ~big["is_text"] & ~big["empty"]
    bad_text = F.coalesce(bad_small, bad_big, F.lit(False))
    reason = F.when(F.col("_json") & ~is_object, "non_object_json").when(
        F.col("_json") & bad_text, "non_string_text"
    )
    judged = parsed.withColumn("quarantine", reason)
    read = judged.withColumns(
        {
            "text": F.when(F.col("quarantine").isNull(), F.coalesce(text, raw)),
            "traceparent": text_field("traceparent"),
            "source_url": text_field("source_url"),
            "fallback": ~F.col("_json"),
        }
    )
    added = ("text", "traceparent", "source_url", "fallback", "quarantine")
    return pin(read.drop("_doc", "_big", "_json"), *added)


def parse_packet(value: Column | str) -> Column:
    """Text of a packet as a single expression (no metadata, no quarantine, variant-size packets)."""
    raw = col_of(value)
    return F.coalesce(F.nullif(string_field(strict_json(raw), "text"), F.lit("")), raw)


def to_raw_json() -> Column:
    """Serialise a crawl envelope."""
    names = ("raw_html", "source_url", "collected_at", "traceparent")
    return F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in names)))


def to_sanitized_json() -> Column:
    """Serialise a sanitized packet; absent metadata is written as null."""
    names = ("text", "length", "source_url", "traceparent")
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
