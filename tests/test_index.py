"""Versioned tables, aliases, migration; readers and writers."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from clearwake.operators.enrich import enrich_text
from clearwake.operators.index import (
    alias_target,
    auto_migrate,
    date_histogram,
    dry_run,
    ensure_target,
    entity_counts,
    flip_alias,
    migrate_single,
    nested_match,
    read_index,
    reindex,
    term_filter,
    text_match,
    versions,
    write_index,
)
from clearwake.operators.sanitize import classify_raw, split
from clearwake.operators.telemetry import burn_rate_of_summaries
from clearwake.operators.policy import policy_scan
from clearwake.schemas import DLQ, INDEX, SchemaMismatch, require_exact
from clearwake.session import scratch_path
from clearwake.sources.readers import read_cases, read_load_summary, read_manifests, read_raw, read_samples, read_sanitized, read_users
from clearwake.sources.writers import write_batch, write_dlq, write_exposition, write_raw, write_sanitized

NOW = datetime.datetime(2024, 1, 1)


def documents(spark, version, texts):
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "id string, text string")
    return enrich_text(rows, model_version=f"m-{version}", schema_version=version, now=NOW, keep=("id",))


@pytest.fixture
def root(spark):
    path = scratch_path(spark, "test-index")
    write_index(documents(spark, "v1", {"a": "one", "b": "two"}), path, "v1", "m-v1", "docs")
    write_index(documents(spark, "v2", {"b": "deux", "c": "trois"}), path, "v2", "m-v2", "docs")
    ensure_target(spark, path, "v0", "m-v0")
    return path


def contents(df):
    return {r["id"]: (r["content"], r["schema_version"], r["model_version"]) for r in df.collect()}


def test_catalog(spark, root):
    assert {r["version"]: r["model_version"] for r in versions(spark, root).collect()} == {"v0": "m-v0", "v1": "m-v1", "v2": "m-v2"}
    # the first written version gets the alias, and keeps it until it is moved
    assert alias_target(spark, root, "docs") == "v1"
    assert contents(read_index(spark, root, alias="docs")).keys() == {"a", "b"}
    flip_alias(spark, root, "docs", "v2")
    assert contents(read_index(spark, root, alias="docs")).keys() == {"b", "c"}
    assert read_index(spark, root, "v0").count() == 0
    for bad in (lambda: flip_alias(spark, root, "docs", "v9"), lambda: read_index(spark, root, "v9"), lambda: read_index(spark, root, alias="none"), lambda: read_index(spark, root)):
        with pytest.raises(ValueError):
            bad()


def test_strict_schema(spark, root):
    good = documents(spark, "v1", {"x": "y"})
    for bad in (good.withColumn("extra", F.lit(1)), good.drop("content"), good.withColumn("risk_score", F.col("risk_score").cast("string"))):
        with pytest.raises(SchemaMismatch):
            write_index(bad, root, "v1", "m")
    write_index(good, root, "v1", "m-v1")
    assert contents(read_index(spark, root, "v1")).keys() == {"a", "b", "x"}


def test_reads_only_the_version(spark, root):
    files = read_index(spark, root, "v2").inputFiles()
    assert files and all("/version=v2/" in f for f in files)


def test_reindex(spark, root):
    moved = reindex(read_index(spark, root, "v1"), read_index(spark, root, "v2"), "v2")
    assert contents(moved.target) == {"a": ("one", "v2", "m-v1"), "b": ("two", "v2", "m-v1"), "c": ("trois", "v2", "m-v2")}
    assert [r["id"] for r in moved.created.collect()] == ["a"] and [r["id"] for r in moved.updated.collect()] == ["b"]
    empty = reindex(read_index(spark, root, "v0"), read_index(spark, root, "v2"), "v2")
    assert contents(empty.target) == contents(read_index(spark, root, "v2")) and empty.created.count() == 0


def test_migrate_single(spark, root):
    before = contents(read_index(spark, root, "v1"))
    assert migrate_single(spark, root, "docs", "v1", "v2", "m-v2")
    assert alias_target(spark, root, "docs") == "v2"
    assert contents(read_index(spark, root, alias="docs"))["b"] == ("two", "v2", "m-v1")
    assert contents(read_index(spark, root, "v1")) == before
    assert not migrate_single(spark, root, "docs", "v7", "v2", "m")
    assert migrate_single(spark, root, "docs", "v1", "v5", "m-v5") and alias_target(spark, root, "docs") == "v5"


def test_auto_migrate(spark, root):
    write_index(documents(spark, "v3", {"b": "drei", "d": "vier"}), root, "v3", "m-v3")
    counts = {r["version"]: r["documents"] for r in dry_run(spark, root, "v3").collect()}
    assert counts == {"v0": 0, "v1": 2, "v2": 2}
    assert auto_migrate(spark, root, "docs", "v3", "m-v3")
    # the last of the old versions wins, over the current one too
    assert contents(read_index(spark, root, alias="docs")) == {
        "a": ("one", "v3", "m-v1"),
        "b": ("deux", "v3", "m-v2"),
        "c": ("trois", "v3", "m-v2"),
        "d": ("vier", "v3", "m-v3"),
    }
    lone = scratch_path(spark, "test-index")
    write_index(documents(spark, "v1", {"a": "x"}), lone, "v1", "m")
    assert auto_migrate(spark, lone, "docs", "v1", "m") and alias_target(spark, lone, "docs") is None


def test_reads(spark):
    base = documents(spark, "v1", {"a": "Password for Ann", "b": "plain words", "c": "ann and ANN"})
    ann = F.struct(F.lit("Ann").alias("text"), F.lit("PERSON").alias("type"))
    org = F.struct(F.lit("Ann").alias("text"), F.lit("ORG").alias("type"))
    df = base.withColumn("entities", F.when(F.col("id") == "a", F.array(ann, ann)).when(F.col("id") == "c", F.array(org)).otherwise(F.col("entities")))

    def ids(found):
        return sorted(r["id"] for r in found.collect())

    assert ids(term_filter(df, "risk_label", "MEDIUM")) == ["a"]
    assert ids(nested_match(df, "PERSON", "Ann")) == ["a"]
    assert ids(text_match(df, ["ann", "password"])) == ["a"] and ids(text_match(df, ["ANN", "plain"], every=False)) == ["a", "b", "c"]
    assert text_match(df, ["pass"]).count() == 0
    assert {(r["type"], r["mentions"], r["documents"]) for r in entity_counts(df).collect()} == {("PERSON", 2, 1), ("ORG", 1, 1)}
    assert {(r["risk_label"], r["documents"]) for r in date_histogram(df).collect()} == {("MEDIUM", 1), ("LOW", 2)}


def test_packet_files(spark):
    raw, clean, dlq = (scratch_path(spark, n) for n in ("raw", "clean", "dlq"))
    pages = spark.createDataFrame(
        [("<p>" + "word " * 20 + "</p>", "u1", "2024-01-01T00:00:00Z", None), (" ", "u2", None, None)],
        "raw_html string, source_url string, collected_at string, traceparent string",
    )
    write_raw(pages, raw)
    parts = split(classify_raw(read_raw(spark, raw)))
    write_sanitized(parts.ok, clean)
    write_dlq(parts.dlq, dlq, "sanitizer")
    packet = json.loads(read_sanitized(spark, clean).first()["value"])
    assert packet == {"text": ("word " * 20).strip(), "length": 107, "source_url": "u1", "traceparent": None}
    letters = spark.read.parquet(dlq)
    require_exact(letters.schema, DLQ)
    assert [(r["stage"], r["error"]) for r in letters.collect()] == [("sanitizer", "empty_raw_html")]


def test_repeated_batch_replaces_itself(spark):
    path = scratch_path(spark, "batches")
    for batch, values in ((0, [1, 2]), (1, [3]), (0, [1, 2])):
        write_batch(spark.createDataFrame([(v,) for v in values], "v int"), path, "a", batch)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_json_sources(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.json").write_text(json.dumps(doc, indent=1))
        return str(tmp_path / name)

    cases = read_cases(spark, put("cases", [{"text": "a", "expected_label": "LOW"}, {"name": "n", "text": "b", "entities": [{"text": "x", "type": "ORG"}], "expected_label": "HIGH"}]))
    assert [len(r["entities"]) for r in cases.orderBy("text").collect()] == [0, 1]
    users = read_users(spark, put("users", {"users": [{"username": "a", "role": "admin", "password": "p"}, {"username": "b"}]}))
    assert {r["username"]: r["role"] for r in users.collect()} == {"a": "admin", "b": "viewer"}
    load = read_load_summary(spark, put("load", {"metrics": {"checks": {"values": {"rate": 0.999}}}, "other": 1}))
    assert burn_rate_of_summaries(load).first()["burn_rate"] == pytest.approx(1.0)
    manifests = read_manifests(spark, put("manifests", {"kind": "Deployment", "metadata": {"name": "d"}}))
    assert {r["rule"] for r in policy_scan(manifests, "kubernetes").collect()} == {"namespace"}


def test_samples_and_exposition(spark):
    path, text = scratch_path(spark, "samples"), scratch_path(spark, "metrics")
    spark.createDataFrame([("j", "m", NOW, 1.0)], "job string, metric string, ts timestamp, value double").write.parquet(path)
    assert tuple(read_samples(spark, path).first()) == ("j", "m", NOW, 1.0)
    write_exposition(spark.createDataFrame([("b", "b 2"), ("a", "a 1")], "metric string, line string"), text)
    assert [r["value"] for r in spark.read.text(text).collect()] == ["a 1", "b 2"]


def test_index_schema_is_the_contract():
    assert INDEX.names[1:] == [
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
    ]
