"""Licence scans: TF-IDF cosine of lines and licence files to templates, then the nearest directory that has one.

Document frequencies of template terms come from all files. A line can only reach the threshold if it shares one of a
template's heaviest terms (the others together are too light for it), so most lines are dropped before
their words are spread out. Everything runs on built-in expressions.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.plans.registry import table
from clearwake.session import cut_lineage

# Notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.7
LICENCE_FILE = r"(?i)^(licen[cs]e|copying)([.-].*)?$"
#: Terms of all templates together; they are compared as literals.
MAX_TERMS = 20_000


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, "[^a-z0-9]+"), lambda w: w != "")


def _literal(terms: Sequence[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")


def template_weights(files: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, idf`` of template terms, and ``license_id, notice, term, weight`` with unit length per notice."""
    notices = templates.where(F.col("license_id").isNotNull()).select(
        "license_id", F.sha1("text").alias("notice"), F.explode(words(F.col("text"))).alias("term")
    )
    counted = notices.groupBy("license_id", "notice", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = [r["term"] for r in counted.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    if len(terms) > MAX_TERMS:
        raise ValueError(f"templates have more than {MAX_TERMS} terms")
    found = files.select(F.explode(F.array_intersect(words(F.col("text")), _literal(sorted(terms)))).alias("term"))
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = files.count()
    idf = cut_lineage(
        counted.select("term").distinct().join(frequency, "term", "left").select(
            "term", (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
        )
    )
    weighted = counted.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    length = weighted.groupBy("license_id", "notice").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    return idf, cut_lineage(
        weighted.join(length, ["license_id", "notice"]).select(
            "license_id", "notice", "term", (F.col("weight") / F.col("length")).alias("weight")
        )
    )


def heavy_terms(weights: DataFrame, threshold: float) -> list[str]:
    """Terms of which a text must have one to reach the threshold with any notice."""
    by_notice: dict[tuple[str, str], list[tuple[float, str]]] = {}
    for row in weights.collect():  # MAX_TERMS bounds each notice
        by_notice.setdefault((row["license_id"], row["notice"]), []).append((row["weight"], row["term"]))
    chosen = set()
    for terms in by_notice.values():
        rest = 0.0
        for weight, term in sorted(terms):
            rest += weight * weight
            if math.sqrt(rest) >= threshold - 1e-9:
                chosen.add(term)
    return sorted(chosen)


def own_licenses(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``path, license, score`` of files with a line, or for licence files a whole text, close to a notice."""
    idf, weights = template_weights(files, templates)
    heavy = _literal(heavy_terms(weights, threshold))
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("section"))
    whole = files.where(F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(LICENCE_FILE))).select(
        "path", F.col("text").alias("section")
    )
    sections = (
        lines.unionByName(whole)
        .withColumn("words", words(F.col("section")))
        .where(F.arrays_overlap("words", heavy))
        .select("path", F.sha1("section").alias("section"), "words")
        .dropDuplicates(["path", "section"])
    )
    counted = sections.select("path", "section", F.explode("words").alias("term")).groupBy("path", "section", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    # words that no notice has weigh as the most common ones
    weighted = counted.join(F.broadcast(idf), "term", "left").withColumn(
        "weight", F.col("tf") * F.coalesce("idf", F.lit(1.0))
    )
    length = weighted.groupBy("path", "section").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    dot = (
        weighted.join(F.broadcast(weights.withColumnRenamed("weight", "share")), "term")
        .groupBy("path", "section", "license_id", "notice")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    )
    scored = dot.join(length, ["path", "section"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6))
    return (
        scored.where(F.col("score") >= threshold)
        .groupBy("path")
        .agg(F.min(F.struct((-F.col("score")).alias("below"), F.col("license_id"))).alias("best"))
        .select("path", F.col("best.license_id").alias("license"), (-F.col("best.below")).alias("score"))
    )


def _directory(path: str = "path") -> Column:
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def scan_licenses(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns and ``path, license, score, inherited_from`` of every row of ``files`` (``path, text``).

    A file's own licence comes first; without one it takes that of the nearest directory above that holds a licence
    file with one, and ``inherited_from`` names the directory ("" is the top). Of several the best score, then the smallest id
    counts. Rows of one path share what any of them has. A null path has no licence; a null or empty text has
    none of its own. Without templates nothing is found.
    """
    own = cut_lineage(own_licenses(files.select("path", "text"), templates, threshold))
    name = F.element_at(F.split("path", "/"), -1)
    licensed = (
        own.where(F.regexp_like(name, F.lit(LICENCE_FILE)))
        .groupBy(_directory().alias("ancestor"))
        .agg(F.min(F.struct((-F.col("score")).alias("below"), F.col("license"))).alias("best"))
        .select("ancestor", F.col("best.license").alias("inherited"))
    )
    folders = files.where(F.col("path").isNotNull()).select(_directory().alias("folder")).distinct()
    parts = F.split("folder", "/")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor")),
    )
    nearest = (
        folders.select("folder", F.explode(steps).alias("step"))
        .select("folder", "step.depth", "step.ancestor")
        .join(licensed, "ancestor")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "ancestor", "inherited")).alias("near"))
        .select("folder", F.col("near.ancestor").alias("ancestor"), F.col("near.inherited").alias("inherited"))
    )
    rows = files.select(*(F.col(c) for c in keep), "path", _directory().alias("folder"))
    joined = rows.join(own, "path", "left").join(nearest, "folder", "left")
    return joined.select(
        *keep,
        "path",
        F.coalesce("license", "inherited").alias("license"),
        "score",
        F.when(F.col("license").isNull(), F.col("ancestor")).alias("inherited_from"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: 64 to a directory, of which one is its licence file, and 16 such directories to one above."""
    shelf = F.expr("cast(doc_id div 64 as string)")
    name = F.when(F.col("doc_id") % 64 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.col("lang"), F.expr("cast(doc_id div 1024 as string)"), shelf, name)
    upper = F.concat_ws("/", F.col("lang"), F.expr("cast(doc_id div 1024 as string)"), F.lit("LICENSE"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 1024 == 1, upper).otherwise(path).alias("path"), "text")


def templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in TEMPLATES))
    return spark.range(1).select(F.inline(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(table(spark, sf_dir, "documents"))
    return scan_licenses(files, templates(spark), THRESHOLD, ("doc_id",))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + ", '[^a-z0-9]+'), lambda w: w <> '')"
SQL = rf"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1024 = 1 THEN lang || '/' || (doc_id // 1024) || '/LICENSE'
    ELSE lang || '/' || (doc_id // 1024) || '/' || (doc_id // 64) || '/' || CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END END AS path
  FROM documents),
notices(license_id, text) AS (VALUES {", ".join(f"('{i}', '{t}')" for i, t in TEMPLATES)}),
notice_terms AS (
  SELECT license_id, term, count(*) AS tf FROM (SELECT license_id, unnest({_WORDS.format("text")}) AS term FROM notices) GROUP BY ALL),
found AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents)),
idf AS (
  SELECT t.term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(f.doc_id))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM notice_terms) t LEFT JOIN found f USING (term) GROUP BY t.term),
weights AS (
  SELECT license_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license_id)) AS share
  FROM notice_terms JOIN idf USING (term)),
sections AS (
  SELECT DISTINCT path, section FROM (
    SELECT path, unnest(string_split(text, chr(10))) AS section FROM files
    UNION ALL SELECT path, text FROM files WHERE ends_with(path, '/LICENSE'))),
counted AS (SELECT path, section, term, count(*) AS tf FROM (SELECT path, section, unnest({_WORDS.format("section")}) AS term FROM sections) GROUP BY ALL),
weighted AS (SELECT path, section, term, tf * coalesce(idf, 1.0) AS weight FROM counted LEFT JOIN idf USING (term)),
lengths AS (SELECT path, section, sqrt(sum(weight * weight)) AS len FROM weighted GROUP BY ALL),
dots AS (SELECT path, section, license_id, sum(weight * share) AS dot FROM weighted JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT path, license_id, round(dot / len, 6) AS score FROM dots JOIN lengths USING (path, section)),
own AS (
  SELECT path, license_id AS license, score FROM scored WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license_id) = 1),
licensed AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, license FROM own WHERE ends_with(path, '/LICENSE')),
placed AS (SELECT DISTINCT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files),
near AS (
  SELECT doc_id, l.folder AS ancestor, l.license FROM placed p JOIN licensed l ON p.folder = l.folder OR starts_with(p.folder, l.folder || '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(l.folder) DESC) = 1)
SELECT doc_id, path, coalesce(own.license, near.license) AS license, score,
       CASE WHEN own.license IS NULL THEN near.ancestor END AS inherited_from
FROM placed LEFT JOIN own USING (path) LEFT JOIN near USING (doc_id)
"""
