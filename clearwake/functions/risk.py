"""Rule scoring as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearwake.functions.text import RISK_KEYWORDS, col_of, count_substring, keyword_hits

# Points per hit, label limits and the score a learned label stands for.
POINTS_PER_KEYWORD = 10
POINTS_PER_ENTITY = 5
LABEL_FLOORS = (("CRITICAL", 50), ("HIGH", 20), ("MEDIUM", 1))
LABEL_SCORES = {"LOW": 0, "MEDIUM": 10, "HIGH": 30, "CRITICAL": 60}

FEATURES = ("keyword_hits", "entity_count", "char_length", "http_count", "at_count")


def risk_score(
    text: Column | str, entities: Column | str, keywords: Sequence[str] = RISK_KEYWORDS
) -> Column:
    return (
        keyword_hits(text, keywords) * POINTS_PER_KEYWORD
        + F.size(col_of(entities)) * POINTS_PER_ENTITY
    ).cast("int")


def risk_label(score: Column | str) -> Column:
    value = col_of(score)
    (first, floor), *rest = LABEL_FLOORS
    out = F.when(value >= floor, first)
    for label, floor in rest:
        out = out.when(value >= floor, label)
    return out.otherwise("LOW")


def label_to_score(label: Column | str) -> Column:
    pairs = [F.lit(x) for pair in LABEL_SCORES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[col_of(label)], F.lit(0))


def featurize(text: Column | str, entities: Column | str) -> dict[str, Column]:
    """The five model inputs, by name."""
    value = col_of(text)
    lowered = F.lower(value)
    return dict(
        zip(
            FEATURES,
            (
                keyword_hits(value),
                F.size(col_of(entities)),
                F.length(value),
                count_substring(lowered, "http"),
                count_substring(lowered, "@"),
            ),
        )
    )
