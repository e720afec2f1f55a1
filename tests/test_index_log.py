"""Changes of an index root by several writers, upserts and migrations of stored versions."""

import datetime
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from clearwake.operators import index
from clearwake.operators.enrich import enrich_text
from clearwake.operators.index import (
    alias_target,
    auto_migrate,
    compact,
    ensure_target,
    flip_alias,
    merge_versions,
    migrate_single,
    read_index,
    reindex,
    with_changes,
    write_index,
)
from clearwake.operators.index_log import commit, history, manifest, numbers
from clearwake.session import scratch_path

NOW = datetime.datetime(2024, 1, 1)


def documents(spark, version, rows, now=NOW):
    frame = spark.createDataFrame(list(rows), "id string, text string")
    return enrich_text(frame, model_version=f"m-{version}", schema_version=version, now=now, keep=("id",))


def texts(df):
    return sorted((r["id"], r["content"]) for r in df.collect())


@pytest.fixture
def root(spark):
    return scratch_path(spark, "test-index-log")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- log -----------------------------------------------------------------------------------------


def test_writers_at_once_lose_nothing(spark, root):
    def add(name):
        commit(spark, root, lambda state: state["aliases"].update({name: "x"}) or f"add {name}")

    names = [f"a{i}" for i in range(40)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, names))
    assert numbers(spark, root) == list(range(1, 41))
    assert set(manifest(spark, root)["aliases"]) == set(names)
    assert sorted(r["change"] for r in history(spark, root).collect()) == sorted(f"add {n}" for n in names)
    # every state has what the one before it had, and one more
    assert [len(manifest(spark, root, n)["aliases"]) for n in numbers(spark, root)] == list(range(1, 41))
    assert not [f for f in os.listdir(f"{root}/log") if f.endswith(".tmp")]


def test_a_taken_number_is_tried_again(spark, root):
    seen = []

    def change(state):
        seen.append(state["seq"])
        if len(seen) == 1:
            # someone else is faster
            flip = lambda other: other["aliases"].update({"b": "y"}) or "other"
            commit(spark, root, flip)
        state["aliases"]["a"] = "x"
        return "mine"

    assert commit(spark, root, change)["aliases"] == {"a": "x", "b": "y"} and seen == [0, 1]


def test_only_a_missing_folder_is_empty(spark, root):
    assert manifest(spark, root)["seq"] == 0
    ensure_target(spark, root, "v1", "m")
    with open(f"{root}/log/00000000000000000002.json", "w") as f:
        f.write("{")
    for read in (lambda: read_index(spark, root, "v1"), lambda: alias_target(spark, root, "a"), lambda: ensure_target(spark, root, "v2", "m")):
        with pytest.raises(ValueError):
            read()


def test_names_of_versions(spark, root):
    for bad in ("", "a/b", "v 1", "x=y", "é/.."):
        with pytest.raises(ValueError):
            ensure_target(spark, root, bad, "m")


# -- upserts -------------------------------------------------------------------------------------


def test_last_write_wins(spark, root):
    later = NOW + datetime.timedelta(hours=1)
    write_index(documents(spark, "v1", [("a", "1"), ("b", "1")]), root, "v1", "m", "docs")
    write_index(documents(spark, "v1", [("b", "2"), ("c", "2")]), root, "v1", "m")
    twice = documents(spark, "v1", [("c", "old")]).unionByName(documents(spark, "v1", [("c", "new")], later))
    write_index(twice, root, "v1", "m")
    want = [("a", "1"), ("b", "2"), ("c", "new")]
    assert texts(read_index(spark, root, alias="docs")) == want
    before = plan(read_index(spark, root, "v1"))
    assert "Exchange" not in before and before.count("FileScan") == 1
    compact(spark, root, "v1")
    assert texts(read_index(spark, root, "v1")) == want
    assert [len(v["parts"]) for v in manifest(spark, root)["versions"].values()] == [1]
    # filters reach the files of a merged version
    assert "EqualTo(risk_label,LOW)" in plan(read_index(spark, root, "v1").where("risk_label = 'LOW'"))


def test_a_repeated_micro_batch_changes_nothing(spark, root):
    write_index(documents(spark, "v1", [("a", "1")]), root, "v1", "m", batch=("run", 0))
    write_index(documents(spark, "v1", [("a", "2")]), root, "v1", "m", batch=("run", 1))
    before = manifest(spark, root)
    write_index(documents(spark, "v1", [("a", "1")]), root, "v1", "m", batch=("run", 0))
    assert manifest(spark, root) == before and texts(read_index(spark, root, "v1")) == [("a", "2")]
    write_index(documents(spark, "v1", [("a", "3")]), root, "v1", "m", batch=("other", 0))
    assert texts(read_index(spark, root, "v1")) == [("a", "3")]


def test_many_parts_are_merged(spark, root, monkeypatch):
    monkeypatch.setattr(index, "MOST_PARTS", 3)
    for i in range(6):
        write_index(documents(spark, "v1", [(str(i), "x"), ("all", str(i))]), root, "v1", "m")
    assert len(manifest(spark, root)["versions"]["v1"]["parts"]) <= 3
    assert texts(read_index(spark, root, "v1")) == [*((str(i), "x") for i in range(6)), ("all", "5")]


def test_what_is_written_during_a_merge_stays(spark, root, monkeypatch):
    for i in range(2):
        write_index(documents(spark, "v1", [("a", str(i))]), root, "v1", "m")
    write, calls = index._write_part, []

    def slow(df, *args):
        part = write(df, *args)
        if not calls:
            calls.append(1)
            write_index(documents(spark, "v1", [("a", "later"), ("b", "later")]), root, "v1", "m")
        return part

    monkeypatch.setattr(index, "_write_part", slow)
    compact(spark, root, "v1")
    assert texts(read_index(spark, root, "v1")) == [("a", "later"), ("b", "later")]


def test_a_lost_merge_is_repeated(spark, root, monkeypatch):
    for i in range(2):
        write_index(documents(spark, "v1", [("a", str(i))]), root, "v1", "m")
    write, calls = index._write_part, []

    def slow(df, *args):
        part = write(df, *args)
        if not calls:
            calls.append(1)
            compact(spark, root, "v1")
            write_index(documents(spark, "v1", [("b", "x")]), root, "v1", "m")
        return part

    monkeypatch.setattr(index, "_write_part", slow)
    compact(spark, root, "v1")
    assert texts(read_index(spark, root, "v1")) == [("a", "1"), ("b", "x")]


def test_rows_without_an_id_stay(spark, root):
    rows = [(None, "one"), (None, "one"), (None, "two"), ("a", "three")]
    write_index(documents(spark, "v1", rows), root, "v1", "m")
    write_index(documents(spark, "v1", rows[:1]), root, "v1", "m")
    stored = texts(read_index(spark, root, "v1"))
    assert sorted(t for _, t in stored) == ["one", "three", "two"] and all(i for i, _ in stored)


# -- migration -----------------------------------------------------------------------------------


def test_null_and_repeated_ids_of_tables(spark):
    old = documents(spark, "v1", [(None, "x"), (None, "y"), ("a", "old"), ("b", "1"), ("b", "1")])
    new = documents(spark, "v2", [("a", "new"), ("c", "2"), ("c", "2"), (None, "x")])
    merged = merge_versions([("v1", old)], new, "v2")
    assert sorted(t for _, t in texts(merged)) == ["1", "2", "old", "x", "y"]
    moved = reindex(old, new, "v2")
    assert moved.target.count() == 5 and moved.created.count() == 2 and moved.updated.count() == 2
    kinds = {r["content"]: r["change"] for r in with_changes(old, new, "v2").collect()}
    assert kinds == {"x": "updated", "y": "created", "old": "updated", "1": "created", "2": "kept"}
    assert {r["schema_version"] for r in moved.target.collect()} == {"v2"}


def test_stored_versions_are_merged_where_they_lie(spark, root, monkeypatch):
    for version in ("v1", "v2", "v3"):
        rows = [(f"{version}{i}", version) for i in range(50)] + [("all", version)]
        write_index(documents(spark, version, rows), root, version, f"m-{version}", "docs")
    plans, write = [], index._write_part

    def watched(df, *args):
        plans.append(plan(df))
        return write(df, *args)

    monkeypatch.setattr(index, "_write_part", watched)
    assert auto_migrate(spark, root, "docs", "v3", "m-v3") and alias_target(spark, root, "docs") == "v3"
    assert len(plans) == 1 and "Exchange" not in plans[0] and plans[0].count("FileScan") == 1
    out = read_index(spark, root, alias="docs")
    assert out.count() == 151 and {r["schema_version"] for r in out.collect()} == {"v3"}
    assert texts(out.where("id = 'all'")) == [("all", "v2")]
    # a second migration changes no row
    before = texts(out)
    assert auto_migrate(spark, root, "docs", "v3", "m-v3") and texts(read_index(spark, root, "v3")) == before


def test_migrate_into_and_from_empty_versions(spark, root):
    ensure_target(spark, root, "v0", "m")
    write_index(documents(spark, "v1", [("a", "1")]), root, "v1", "m", "docs")
    assert migrate_single(spark, root, "docs", "v1", "v5", "m5") and texts(read_index(spark, root, alias="docs")) == [("a", "1")]
    assert migrate_single(spark, root, "docs", "v0", "v5", "m5") and texts(read_index(spark, root, "v5")) == [("a", "1")]
    assert migrate_single(spark, root, "docs", "v0", "v6", "m6") and read_index(spark, root, alias="docs").count() == 0
    flip_alias(spark, root, "docs", "v1")
    assert texts(read_index(spark, root, alias="docs")) == [("a", "1")]


def test_names_of_tables_do_not_stay(spark, root):
    write_index(documents(spark, "v1", [("a", "1")]), root, "v1", "m")
    out = read_index(spark, root, "v1")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clearwake")]
    assert out.count() == 1 and spark.conf.get("spark.sql.hive.manageFilesourcePartitions") == "true"
    assert out.where(F.col("id") == "a").count() == 1
