"""Versioned document tables, alias switching, migration and reads.

A root folder holds immutable parts and a log of manifests (``index_log``). A manifest says which parts a version consists
of, oldest first, and which version an alias points at. A change writes its parts first and then the next manifest, so a
reader sees the old state or the new one and nothing in between, and of two writers at once neither loses a change.

A version has one row per id, that of the newest part which has the id. Parts are bucketed by id, all of a root into as many
buckets, so the parts of a version, or of several, are merged where they lie: one scan of each, no exchange. A version that
is one part is read as it is. Many small parts, as streams leave them, are merged into one now and then.

Within one write the newest row of an id counts, by ``timestamp`` and then by a hash of the row. A row without an id gets a
hash of its content, address and trace context as its id, so that no row vanishes and repeated ones are one.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearwake.functions.text import word_tokens
from clearwake.operators.index_log import commit, manifest
from clearwake.schemas import INDEX, require_exact

#: Parts of a version before the next write merges them.
MOST_PARTS = 16
#: Times a merge starts anew because another one was faster.
MERGE_ATTEMPTS = 5


class Reindexed(NamedTuple):
    target: DataFrame
    created: DataFrame
    updated: DataFrame


# -- catalog -------------------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Every version with its model version and number of parts."""
    state = manifest(spark, root)
    rows = [(name, v["model_version"], len(v["parts"])) for name, v in sorted(state["versions"].items())]
    return spark.createDataFrame(rows, "version string, model_version string, parts int")


def alias_target(spark: SparkSession, root: str, alias: str) -> str | None:
    return manifest(spark, root)["aliases"].get(alias)


def flip_alias(spark: SparkSession, root: str, alias: str, version: str) -> None:
    """Point the alias at exactly one version, in one step."""

    def change(state: dict) -> str | None:
        if version not in state["versions"]:
            raise ValueError(f"unknown version {version}")
        if state["aliases"].get(alias) == version:
            return None
        state["aliases"][alias] = version
        return f"alias {alias} to {version}"

    commit(spark, root, change)


def ensure_target(spark: SparkSession, root: str, version: str, model_version: str) -> dict:
    """The state of the log with the version in it; an empty one is added if there is none."""

    def change(state: dict) -> str | None:
        if version in state["versions"]:
            return None
        _add_version(spark, state, version, model_version)
        return f"create {version}"

    return commit(spark, root, change)


def _add_version(spark: SparkSession, state: dict, version: str, model_version: str) -> None:
    if not re.fullmatch(r"[\w.-]+", version):
        raise ValueError(f"{version!r} can't name a version: letters, digits, '_', '.' and '-' can")
    # all parts of a root have as many buckets
    state["buckets"] = state["buckets"] or int(spark.conf.get("spark.sql.shuffle.partitions"))
    state["versions"][version] = {"model_version": model_version, "parts": []}


# -- parts ---------------------------------------------------------------------------------------

_STORED = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in INDEX.fields)
_UNMANAGED = "spark.sql.hive.manageFilesourcePartitions"
_UNMANAGED_LOCK = threading.Lock()


def keyed(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with a hash of the row's content, address and trace context where it has no key."""
    own = F.sha2(F.to_json(F.struct(*(F.col(c) for c in ("content", "source_url", "traceparent") if c in df.columns))), 256)
    return df.withColumn(key, F.coalesce(key, own))


def newest_rows(df: DataFrame, key: str = "id", time: str = "timestamp") -> DataFrame:
    """One row per key. Every task keeps one row of a key before rows are exchanged, however often the key occurs."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(time), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _folder(root: str, version: str, part: str) -> str:
    return f"{root}/data/version={version}/part={part}"


def _write_part(df: DataFrame, root: str, version: str, buckets: int) -> str:
    """Write rows with different ids as a part; its name."""
    part, table = uuid.uuid4().hex, f"clearwake_{uuid.uuid4().hex}"
    stored = df.select(*INDEX.names).write.bucketBy(buckets, "id").sortBy("id").option("path", _folder(root, version, part))
    stored.saveAsTable(table)
    # the files stay
    df.sparkSession.sql(f"DROP TABLE {table}")
    return part


def _table(spark: SparkSession, folder: str, buckets: int, *levels: str) -> DataFrame:
    """A folder of bucketed files, with folders named after ``levels`` in it, as a table."""
    table = f"clearwake_{uuid.uuid4().hex}"
    columns = ", ".join([_STORED, *(f"`{x}` string" for x in levels)])
    partitioned = f"PARTITIONED BY ({', '.join(levels)})" if levels else ""
    # folders are found by listing, so the frame outlives the table's name
    with _UNMANAGED_LOCK:
        before = spark.conf.get(_UNMANAGED)
        spark.conf.set(_UNMANAGED, "false")
        try:
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet {partitioned} "
                f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{folder}'"
            )
            return spark.table(table)
        finally:
            spark.conf.set(_UNMANAGED, before)
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def _merged(spark: SparkSession, root: str, versions: Sequence[str], parts: Sequence[str], buckets: int) -> DataFrame:
    """For every id the row of the last of ``parts`` that has it, with ``part``; rows stay in their buckets.

    One table lies over all parts of the versions and is pruned to these: a union of bucketed tables does not keep the rows
    of one id together.
    """
    several = len(set(versions)) > 1
    folder = f"{root}/data" if several else f"{root}/data/version={versions[0]}"
    rows = _table(spark, folder, buckets, *(["version", "part"] if several else ["part"])).where(F.col("part").isin(*parts))
    place = F.create_map(*(F.lit(x) for i, p in enumerate(parts) for x in (p, i)))[F.col("part")]
    values = F.struct(*INDEX.names[1:], "part")
    return rows.groupBy("id").agg(F.max_by(values, place).alias("_row")).select("id", "_row.*")


def _read(spark: SparkSession, root: str, state: dict, version: str) -> DataFrame:
    parts = state["versions"][version]["parts"]
    if not parts:
        return spark.createDataFrame([], INDEX)
    if len(parts) == 1:
        return _table(spark, _folder(root, version, parts[0]), state["buckets"])
    return _merged(spark, root, [version], parts, state["buckets"]).select(*INDEX.names)


def write_index(
    df: DataFrame,
    root: str,
    version: str,
    model_version: str,
    alias: str | None = None,
    batch: tuple[str, int] | None = None,
) -> None:
    """Upsert scored documents into a version; rows that do not fit the strict schema are refused.

    ``batch`` names a run and the number of its micro-batch: one that was committed before changes nothing.
    """
    require_exact(df.schema, INDEX)
    spark = df.sparkSession
    state = ensure_target(spark, root, version, model_version)

    def done(state: dict) -> bool:
        return batch is not None and state["batches"].get(batch[0], -1) >= batch[1]

    if done(state):
        return
    part = _write_part(newest_rows(keyed(df)), root, version, state["buckets"])

    def change(state: dict) -> str | None:
        if done(state):
            return None
        state["versions"][version]["parts"].append(part)
        if batch is not None:
            state["batches"][batch[0]] = batch[1]
        if alias is not None:
            state["aliases"].setdefault(alias, version)
        return f"write {version}" + (f" batch {batch[1]} of {batch[0]}" if batch else "")

    if len(commit(spark, root, change)["versions"][version]["parts"]) > MOST_PARTS:
        compact(spark, root, version)


def _replace(spark: SparkSession, root: str, version: str, said: str, build) -> None:
    """Put one new part in the place of a version's parts; what others add in the meantime stays behind it.

    ``build(state)`` gives the rows and the parts they were made of, by version. If one of these versions was merged by
    someone else in the meantime, it is built anew.
    """
    for _ in range(MERGE_ATTEMPTS):
        state = manifest(spark, root)
        rows, used = build(state)
        part = _write_part(rows, root, version, state["buckets"])

        def change(now: dict) -> str | None:
            old = used[version]
            if any(now["versions"][v]["parts"][: len(parts)] != parts for v, parts in used.items()):
                return None
            mine = now["versions"][version]
            mine["parts"] = [part, *mine["parts"][len(old) :]]
            return said

        if part in commit(spark, root, change)["versions"][version]["parts"]:
            return
    raise RuntimeError(f"{said}: other merges were faster {MERGE_ATTEMPTS} times")


def compact(spark: SparkSession, root: str, version: str) -> None:
    """Merge a version's parts into one. Buckets stay where they are."""

    def build(state: dict):
        return _read(spark, root, state, version), {version: list(state["versions"][version]["parts"])}

    if len(manifest(spark, root)["versions"].get(version, {"parts": []})["parts"]) > 1:
        _replace(spark, root, version, f"compact {version}", build)


def read_index(
    spark: SparkSession, root: str, version: str | None = None, alias: str | None = None
) -> DataFrame:
    """One version's documents, or those the alias points at. Only that version's files are read."""
    state = manifest(spark, root)
    if version is None:
        if alias is None:
            raise ValueError("give a version or an alias")
        version = state["aliases"].get(alias)
    if version not in state["versions"]:
        raise ValueError(f"no such version: {version}")
    return _read(spark, root, state, version)


# -- migration -----------------------------------------------------------------------------------


def _overlaid(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Of tables in rising precedence the last one's row for every key, with ``_seen`` (a bit for each table that has it)."""
    numbered = [
        newest_rows(keyed(df, key), key).withColumn("_order", F.lit(1 << i).cast("long")) for i, df in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, numbered)
    values = F.struct(*(c for c in rows.columns if c != key))
    found = rows.groupBy(key).agg(F.max_by(values, "_order").alias("_row"), F.bit_or("_order").alias("_seen"))
    return found.select(key, "_row.*", "_seen")


def with_changes(source: DataFrame, target: DataFrame, version: str, key: str = "id") -> DataFrame:
    """``source`` over ``target`` in one pass: the new rows and ``change`` (created, updated or kept).

    Of the rows of a key in one table the newest counts; a row without a key gets one (``keyed``).
    """
    found = _overlaid([target, source.withColumn("schema_version", F.lit(version))], key)
    change = F.when(F.col("_seen") == 1, "kept").when(F.col("_seen") == 2, "created").otherwise("updated")
    return found.select(*target.columns, change.alias("change"))


def reindex(source: DataFrame, target: DataFrame, version: str, key: str = "id") -> Reindexed:
    """Copy ``source`` over ``target``: same key overwrites, only ``schema_version`` changes.

    ``created`` and ``updated`` hold the keys.
    """
    found = with_changes(source, target, version, key)
    return Reindexed(
        found.drop("change"),
        found.where("change = 'created'").select(key),
        found.where("change = 'updated'").select(key),
    )


def old_versions(catalog: DataFrame, current: str) -> DataFrame:
    """Every version except the current one."""
    return catalog.where(F.col("version") != current)


def merge_versions(
    sources: Iterable[tuple[str, DataFrame]], current: DataFrame, version: str, key: str = "id"
) -> DataFrame:
    """All old versions over the current one: per key the last source wins. Documents are exchanged once."""
    stamped = [df.withColumn("schema_version", F.lit(version)) for _, df in sorted(sources, key=lambda pair: pair[0])]
    return _overlaid([current, *stamped], key).select(*current.columns)


def _migrate(spark: SparkSession, root: str, alias: str, old: Sequence[str], target: str, model_version: str) -> None:
    """Stored versions over the target, in the order given. One scan of every part, no exchange."""
    ensure_target(spark, root, target, model_version)

    def build(state: dict):
        used = {v: list(state["versions"][v]["parts"]) for v in (target, *old)}
        parts = [p for v in (target, *old) for p in used[v]]
        if not parts:
            return spark.createDataFrame([], INDEX), used
        merged = _merged(spark, root, [target, *old], parts, state["buckets"])
        own = F.col("part").isin(*used[target]) if used[target] else F.lit(False)
        return merged.withColumn("schema_version", F.when(own, F.col("schema_version")).otherwise(F.lit(target))), used

    _replace(spark, root, target, f"migrate {', '.join(old)} to {target}", build)
    flip_alias(spark, root, alias, target)


def migrate_single(
    spark: SparkSession, root: str, alias: str, source: str, target: str, model_version: str
) -> bool:
    """Move one version into another and point the alias there; false if there is no source."""
    if source not in manifest(spark, root)["versions"]:
        return False
    _migrate(spark, root, alias, [source], target, model_version)
    return True


def auto_migrate(spark: SparkSession, root: str, alias: str, current: str, model_version: str) -> bool:
    """Move every other version into the current one and point the alias there."""
    old = sorted(v for v in manifest(spark, root)["versions"] if v != current)
    if old:
        _migrate(spark, root, alias, old, current, model_version)
    return True


def index_counts(documents: DataFrame) -> DataFrame:
    """Documents per version: what a migration would move."""
    return documents.groupBy("schema_version").agg(F.count(F.lit(1)).alias("documents"))


def dry_run(spark: SparkSession, root: str, current: str) -> DataFrame:
    """Document count of every old version, the empty ones included."""
    out = spark.createDataFrame([], "version STRING, documents LONG")
    names = old_versions(versions(spark, root), current).select("version")
    for row in names.toLocalIterator():
        counted = read_index(spark, root, row["version"]).agg(F.count(F.lit(1)).alias("documents"))
        out = out.unionByName(counted.withColumn("version", F.lit(row["version"])))
    return out


# -- reads ---------------------------------------------------------------------------------------


def term_filter(index: DataFrame, field: str, *terms: str) -> DataFrame:
    """Exact match of a keyword field."""
    return index.where(F.col(field).isin(*terms))


def range_filter(
    index: DataFrame, field: str, low: int | datetime | Column | None = None, high: int | datetime | Column | None = None
) -> DataFrame:
    """``low <= field < high`` on a number or date; either end may be open."""
    out = index
    if low is not None:
        out = out.where(F.col(field) >= low)
    if high is not None:
        out = out.where(F.col(field) < high)
    return out


def nested_match(index: DataFrame, type_: str, text: str) -> DataFrame:
    """Documents with one entity that has both the type and the text."""
    return index.where(F.exists("entities", lambda e: (e["type"] == type_) & (e["text"] == text)))


def text_match(index: DataFrame, terms: Iterable[str], every: bool = True, field: str = "content") -> DataFrame:
    """Documents whose words include all (or any) of the terms, ignoring case."""
    wanted = F.array(*(F.lit(t.lower()) for t in terms))
    words = word_tokens(field)
    if every:
        return index.where(F.size(F.array_except(wanted, words)) == 0)
    return index.where(F.arrays_overlap(words, wanted))


def date_histogram(index: DataFrame, unit: str = "day") -> DataFrame:
    """Documents per time bucket and label."""
    return index.groupBy(F.date_trunc(unit, "timestamp").alias("bucket"), "risk_label").agg(
        F.count(F.lit(1)).alias("documents")
    )


def label_distribution(index: DataFrame) -> DataFrame:
    return index.groupBy("schema_version", "risk_label").agg(F.count(F.lit(1)).alias("documents"))


def entity_counts(index: DataFrame) -> DataFrame:
    """Mentions per entity, and the documents (by ``id``) they are in."""
    mentions = index.select("id", F.explode("entities").alias("_e")).select("id", "_e.type", "_e.text")
    per_document = mentions.groupBy("id", "type", "text").agg(F.count(F.lit(1)).alias("_n"))
    return per_document.groupBy("type", "text").agg(
        F.sum("_n").alias("mentions"), F.count(F.lit(1)).alias("documents")
    )
