"""Entity extractors: DataFrame in, DataFrame with an ``entities`` column out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwake.functions.staging import pin
from clearwake.functions.text import truncate
from clearwake.schemas import ENTITIES
from clearwake.session import broadcast_if_small

# The entity types that are kept.
ENTITY_TYPES = ("PERSON", "ORG", "GPE")

Extractor = Callable[[DataFrame, str], DataFrame]

# Above this many phrases a pattern stops paying and the phrases are joined as a table.
MAX_PATTERN_PHRASES = 500
# A dictionary of up to this many phrases is broadcast.
BROADCAST_PHRASES = 100_000
#: Slots of the filter that n-grams pass first, a power of two.
FILTER_SLOTS = 1 << 20


def blank_extractor(df: DataFrame, text: str = "text") -> DataFrame:
    """Finds nothing: the behaviour of a language model without an entity recogniser."""
    return df.withColumn("entities", F.array().cast(ENTITIES))


def gazetteer_extractor(
    phrases: Sequence[tuple[str, str]], chars: int | None = None
) -> Extractor:
    """Longest match first, left to right, case-sensitive, whole words; duplicates are kept.

    A short phrase list becomes one pattern evaluated inside the row, so extraction needs no
    shuffle. Use ``gazetteer_join`` for a dictionary table.
    """
    known = {phrase: kind for phrase, kind in phrases if kind in ENTITY_TYPES}
    if len(known) > MAX_PATTERN_PHRASES:
        raise ValueError(f"{len(known)} phrases: use gazetteer_join with a dictionary table")
    if not known:
        return blank_extractor
    ordered = sorted(known, key=lambda p: (-len(p), p))
    body = "|".join(re.sub(r"([\\.\[\]{}()*+\-?^$|&#~])", r"\\\1", p) for p in ordered)
    pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"

    def extract(df: DataFrame, text: str = "text") -> DataFrame:
        kinds = [F.lit(x) for pair in known.items() for x in pair]
        source = F.col(text) if chars is None else truncate(text, chars)
        found = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
        typed = F.transform(
            found, lambda p: F.struct(p.alias("text"), F.create_map(*kinds)[p].alias("type"))
        )
        return pin(df.withColumn("entities", F.coalesce(typed, F.array()).cast(ENTITIES)), "entities")

    return extract


def _phrase_filter(known: DataFrame) -> Callable[[Column], Column]:
    """Whether a phrase may be in the dictionary: false for nearly all that are not, true for all that are.

    A byte for each of up to ``FILTER_SLOTS`` hash values, as a constant of the plan.
    """
    slots = 1 << min(FILTER_SLOTS.bit_length() - 1, max(10, (16 * known.count()).bit_length()))

    def slot(phrase: Column | str) -> Column:
        return F.pmod(F.xxhash64(phrase), F.lit(slots)).cast("int")

    taken = bytearray(slots)
    # at most FILTER_SLOTS numbers
    for row in known.select(slot("phrase").alias("slot")).distinct().toArrow().column("slot").to_pylist():
        taken[row] = 1
    return lambda phrase: F.substring(F.lit(taken), slot(phrase) + 1, 1) == F.lit(bytearray(b"\x01"))


def gazetteer_join(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    text: str = "text",
    max_words: int = 4,
    chars: int | None = None,
) -> DataFrame:
    """Same matches from a dictionary table ``(phrase, type)`` of any size.

    Word n-grams that can't be in the dictionary are left out inside the row, by a filter of its hashes, so what is joined
    and exchanged grows with the hits and not with the text. The rest is joined with the dictionary: a frequent phrase is
    only a frequent join key on the large side (Spark broadcasts a small dictionary, or splits a skewed partition).
    Only hits are grouped per document. Words are separated by single spaces; ``key`` must
    identify a row.
    """
    source = F.col(text) if chars is None else truncate(text, chars)
    known = (
        dictionary.where(F.col("type").isin(*ENTITY_TYPES))
        .groupBy("phrase")
        .agg(F.min("type").alias("type"))
    )
    known = broadcast_if_small(known, BROADCAST_PHRASES)
    possible = _phrase_filter(known)
    # words and the gaps between them alternate, so neighbours can be checked in place
    words = df.select(
        F.col(key),
        F.regexp_extract_all(source, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("_w"),
        F.split(source, r"[\p{L}\p{N}_]+").alias("_gap"),
    ).where(F.size("_w") > 0)
    places = F.sequence(F.lit(0), F.size("_w") - 1)

    def phrases_of(n: int) -> Column:
        """Runs of n words with single spaces between them; null where there is none."""

        def at(p: Column) -> Column:
            phrase = F.concat_ws(" ", *(F.get("_w", p + i) for i in range(n)))
            joined = [F.get("_gap", p + i) == " " for i in range(1, n)]
            whole = reduce(and_, joined, p + n <= F.size("_w"))
            return F.when(
                whole, F.struct(p.alias("pos"), F.lit(n).alias("n"), phrase.alias("phrase"))
            )

        return F.filter(F.transform(places, at), lambda g: g.isNotNull() & possible(g["phrase"]))

    every = F.concat(*(phrases_of(n) for n in range(1, max_words + 1)))
    spread_out = words.select(key, F.explode(every).alias("_g"))
    grams = spread_out.select(
        key, F.col("_g.pos").alias("_pos"), F.col("_g.n").alias("_n"), F.col("_g.phrase").alias("phrase")
    )
    # a merge hint gives way to a broadcast one, and keeps Spark from broadcasting the n-grams
    hits = grams.hint("merge").join(known, "phrase").groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_pos").alias("pos"),
                    (-F.col("_n")).alias("neg_n"),
                    F.col("phrase").alias("text"),
                    F.col("type"),
                )
            )
        ).alias("_hits")
    )
    start = F.struct(F.lit(0).alias("next"), F.array().cast(ENTITIES).alias("kept"))

    def keep(acc, hit):
        free = hit["pos"] >= acc["next"]
        entity = F.struct(hit["text"].alias("text"), hit["type"].alias("type"))
        return F.struct(
            F.when(free, hit["pos"] - hit["neg_n"]).otherwise(acc["next"]).alias("next"),
            F.when(free, F.array_append(acc["kept"], entity)).otherwise(acc["kept"]).alias("kept"),
        )

    if max_words == 1:  # single words cannot overlap
        entities = F.transform("_hits", lambda h: F.struct(h["text"].alias("text"), h["type"].alias("type")))
    else:
        entities = F.aggregate("_hits", start, keep, lambda acc: acc["kept"])
    found = hits.select(key, entities.alias("entities"))
    joined = df.join(found, key, "left")
    return joined.withColumn("entities", F.coalesce("entities", F.array().cast(ENTITIES)))


def model_extractor(
    load: Callable[[], Callable[[str], list[tuple[str, str]]]], chars: int | None = None
) -> Extractor:
    """Plug point for a user's own recogniser; ``load`` runs once per Python worker task.

    ``load()`` returns a function from a text to (entity text, entity type) pairs in order.
    """

    def extract(df: DataFrame, text: str = "text") -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("entities", ENTITIES)])

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            recognise = load()
            for frame in frames:
                frame["entities"] = [
                    [
                        {"text": found, "type": kind}
                        for found, kind in recognise((value or "")[:chars])
                        if kind in ENTITY_TYPES
                    ]
                    for value in frame[text]
                ]
                yield frame

        return df.mapInPandas(batches, schema)

    return extract
