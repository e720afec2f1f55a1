"""A training corpus from raw documents: good texts, one of each group, no test passages, no secrets, packed.

Every stage takes ``(spark, docs, sf_dir)``; its result is written and read again before the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.llm import decontamination, importance, jaccard_join, packing, secret_scan
from clearwake.plans.registry import table
from clearwake.session import configure, scratch_path


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    if not {"text", "n_chars"} <= set(docs.columns):
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as good as labelled ones; what the classifier rejects goes."""
    return importance.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard_join.one_per_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that consist of them to a large part go."""
    return _measured(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _measured(secret_scan.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of one length."""
    return packing.digest_columns(packing.pack_documents(docs))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scan", secrets),
    ("packing", sequences),
]

#: Models and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
