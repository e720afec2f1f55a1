"""Streams against their batch counterparts: restarts, late rows, state."""

import datetime

import pytest
from pyspark.sql import functions as F

from clearwake.operators.enrich import enrich
from clearwake.operators.index import read_index
from clearwake.operators.sanitize import classify_raw, split
from clearwake.operators.telemetry import canary_verdict, outcome_ratio
from clearwake.plans.stream_plans import drain, run_to_end, run_to_table
from clearwake.session import scratch_path
from clearwake.sources.readers import read_raw
from clearwake.streaming.canary import _observe, stream_canary
from clearwake.sources.writers import write_batch
from clearwake.streaming.jobs import stream_dedupe, stream_enrich, stream_error_ratio, stream_index, stream_latency, stream_sanitize
from test_operations import VERDICTS
from test_packets import RAW, SANITIZED

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def put(df, path):
    """Add one file to a folder that is streamed."""
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


PACKET = "id long, value string"


def packet_frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), PACKET)


def test_sanitize_restarted_midway(spark):
    """Stop with input waiting, start again from the checkpoint: nothing lost, nothing twice."""
    source, out, dlq, ckpt = (scratch_path(spark, n) for n in ("in", "out", "dlq", "ckpt"))
    packets = packet_frame(spark, [r[0] for r in RAW] * 3)

    def run(files):
        for part in files:
            put(packets.where(F.col("id") % 4 == part), source)
        drain(stream_sanitize(stream(spark, source, PACKET), out, dlq, ckpt, 3, keep=("id",)))

    run([0, 1])
    assert spark.read.parquet(out).count() < split(classify_raw(packets, 3)).ok.count()
    run([2, 3])
    run([])
    want = split(classify_raw(packets, 3), keep=("id",))
    assert same(spark.read.parquet(out).drop("run", "batch_id"), want.ok)
    assert same(spark.read.parquet(dlq).select("id", "error", "payload"), want.dlq)


def test_lost_progress_repeats_a_batch(spark):
    """A batch whose commit was lost is done again and replaces its own rows."""
    out = scratch_path(spark, "out")
    for values in ([1, 2, 3], [1, 2]):
        write_batch(spark.createDataFrame([(v,) for v in values], "v int"), out, "one", 0)
    write_batch(spark.createDataFrame([(9,)], "v int"), out, "two", 0)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [1, 2, 9]


def test_new_checkpoint_keeps_older_output(spark):
    """The batches of another run have the same numbers, but other rows."""
    first, second, out, dlq = (scratch_path(spark, n) for n in ("first", "second", "out", "dlq"))
    packets = packet_frame(spark, [r[0] for r in RAW])
    for part, source in enumerate((first, second)):
        put(packets.where(F.col("id") % 2 == part), source)
        drain(stream_sanitize(stream(spark, source, PACKET), out, dlq, scratch_path(spark, f"ckpt{part}"), 3, keep=("id",)))
    want = split(classify_raw(packets, 3), keep=("id",))
    assert same(spark.read.parquet(out).drop("run", "batch_id"), want.ok)


def test_enrich_equals_batch(spark):
    source, out, dlq = (scratch_path(spark, n) for n in ("in", "out", "dlq"))
    packets = packet_frame(spark, [r[0] for r in SANITIZED])
    for part in range(2):
        put(packets.where(F.col("id") % 2 == part), source)
    options = {"id_column": "id", "model_version": "m", "now": T0}
    drain(stream_enrich(stream(spark, source, PACKET), out, dlq, scratch_path(spark, "ckpt"), **options))
    want = enrich(packets, **options)
    assert same(spark.read.parquet(out).drop("run", "batch_id"), want.ok)
    assert same(spark.read.parquet(dlq).select("error", "payload"), want.dlq.select("error", "payload"))


def test_text_source_as_stream(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("<p>a</p>",), ('{"raw_html":"b"}',)], "value string").write.text(path)
    got = run_to_table(read_raw(spark, path, stream=True), "copied")
    assert same(got, read_raw(spark, path))


def test_late_rows_are_dropped(spark):
    source = scratch_path(spark, "in")
    schema = "deployment string, ts timestamp, failed boolean"

    def rows(*points):
        return spark.createDataFrame([("d", at(s), failed) for s, failed in points], schema)

    put(rows((0, True), (10, False), (20, False)), source)
    put(rows((600, False)), source)
    put(rows((601, False)), source)
    put(rows((30, True), (610, True)), source)  # the first one is long past the watermark
    put(rows((1200, False)), source)
    put(rows((1800, False)), source)
    found = run_to_table(stream_error_ratio(stream(spark, source, schema)), "ratios").orderBy("ts").collect()
    assert [(r["ts"], r["failures"], r["processed"], r["ratio"]) for r in found[:2]] == [(at(0), 1, 2, 0.5), (at(600), 1, 2, 0.5)]


def test_canary_equals_batch(spark):
    source = scratch_path(spark, "in")
    schema = "deployment string, ts timestamp, ratio double"
    rows = [(d, at(15 * i), r) for d, (ratios, _) in VERDICTS.items() for i, r in enumerate([*ratios, 0.0, 0.0, 0.0, 0.0][:4])]
    df = spark.createDataFrame(rows, schema)
    for i in range(4):
        put(df.where(F.col("ts") == F.lit(at(15 * i))), source)
    got = {r["deployment"]: (r["verdict"], r["samples"]) for r in run_to_table(stream_canary(stream(spark, source, schema), 0.25, 4), "verdicts").collect()}
    want = {r["deployment"]: (r["verdict"], r["samples"]) for r in canary_verdict(df, 0.25).collect()}
    assert got == want and got["spike"] == ("ROLLBACK_SPIKE", 2)


def test_canary_with_few_or_unordered_samples(spark):
    """Fewer samples than wanted decide after a time-out; those of a later micro-batch take their place in time."""
    schema = "deployment string, ts timestamp, ratio double"
    source = scratch_path(spark, "in")
    for part in (
        [("few", 0, 0.1), ("few", 30, 0.2), ("bad", 0, 0.5), ("mixed", 0, 0.0), ("mixed", 30, 0.9)],
        [("mixed", 15, 0.8)],
        [("clock", 400, 0.0)],
    ):
        put(spark.createDataFrame([(d, at(s), r) for d, s, r in part], schema), source)
    found = run_to_table(stream_canary(stream(spark, source, schema), 0.25), "verdicts").collect()
    got = {r["deployment"]: (r["verdict"], r["samples"], round(r["mean_ratio"], 9)) for r in found}
    assert got == {"few": ("PROMOTE", 2, 0.15), "bad": ("ROLLBACK_AVG", 1, 0.5), "mixed": ("ROLLBACK_SPIKE", 2, 0.4)}
    assert len(found) == 3


def test_a_verdict_is_given_once():
    state, verdict = _observe([0.9], (0.0, 0, False), 0.25, 8)
    assert verdict == "ROLLBACK_SPIKE"
    assert _observe([0.9, 0.0], state, 0.25, 8) == (state, None)
    state, verdict = _observe([0.1] * 3, (0.0, 0, False), 0.25, 4)
    assert verdict is None and _observe([0.1], state, 0.25, 4)[1] == "PROMOTE"


def test_latency_join(spark):
    left, right = scratch_path(spark, "left"), scratch_path(spark, "right")
    trace = lambda n: f"00-{n:032x}-{1:016x}-01"
    raw_schema, index_schema = "traceparent string, collected_at timestamp", "traceparent string, timestamp timestamp"
    put(spark.createDataFrame([(trace(n), at(n)) for n in range(4)], raw_schema), left)
    put(spark.createDataFrame([(trace(1), at(11)), (trace(2), at(7200)), (trace(0), at(5)), (trace(3), at(1))], index_schema), right)
    found = run_to_table(stream_latency(stream(spark, left, raw_schema), stream(spark, right, index_schema)), "latency").collect()
    # 2 is beyond the limit, 0 has no valid id, 3 ends before it starts
    assert [(int(r["trace_id"], 16), r["latency_s"]) for r in found] == [(1, 10.0)]


def test_latency_of_slow_packets(spark):
    """A packet that is indexed too late, or never, has a row; rows behind the watermark are counted."""
    left, right, out = (scratch_path(spark, n) for n in ("left", "right", "out"))
    trace = lambda n: f"00-{n:032x}-{1:016x}-01"
    raw_schema, index_schema = "traceparent string, collected_at timestamp", "traceparent string, timestamp timestamp"
    for points in ([(1, 0), (2, 0), (3, 0)], [(8, 40_000)], [(9, 80_000)], [(7, 1)]):
        put(spark.createDataFrame([(trace(n), at(s)) for n, s in points], raw_schema), left)
    for points in ([(1, 10), (2, 7200)], [(8, 40_010)], [(9, 80_005)], [(9, 80_010)]):
        put(spark.createDataFrame([(trace(n), at(s)) for n, s in points], index_schema), right)
    found = stream_latency(stream(spark, left, raw_schema), stream(spark, right, index_schema))
    writer = found.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").option("path", out)
    with pytest.warns(UserWarning, match="1 rows"):
        assert drain(writer) == 1
    got = sorted((int(r["trace_id"], 16), r["latency_s"]) for r in spark.read.parquet(out).where("collected_at < '2024-01-01 12:00:00'").collect())
    assert got == [(1, 10.0), (2, None), (3, None), (8, 10.0)]


def test_dedupe(spark):
    source = scratch_path(spark, "in")
    schema = "url string, ts timestamp"
    for start in (0, 100, 200):
        rows = [("hub", at(start + i)) for i in range(50)] + [(f"u{start + i}", at(start + i)) for i in range(3)] + [("twice", at(start))]
        put(spark.createDataFrame(rows, schema), source)
    found = sorted(r["url"] for r in run_to_table(stream_dedupe(stream(spark, source, schema)), "urls").collect())
    assert found == sorted(["hub", "twice"] + [f"u{s + i}" for s in (0, 100, 200) for i in range(3)])


def test_last_windows_are_closed_at_the_end(spark):
    """Every window of the batch form, and nothing of the tick itself."""
    source = scratch_path(spark, "in")
    schema = "deployment string, ts timestamp, failed boolean"
    rows = spark.createDataFrame([(d, at(s), s % 3 == 0) for d in ("a", "b", None) for s in range(0, 400, 7)], schema)
    for part in range(4):
        put(rows.where(F.floor(F.unix_seconds("ts") % 400 / 100) == part), source)
    put(rows.where("false"), source)
    found = run_to_end("ratios", stream_error_ratio, (stream(spark, source, schema), "ts", {}))
    want = outcome_ratio(rows)
    assert same(found, want) and found.where("deployment IS NULL").count()


def test_canary_drops_nulls_and_fails_closed(spark):
    schema = "deployment string, ts timestamp, ratio double"
    source = scratch_path(spark, "in")
    rows = [("null", 0, None), ("null", 15, 0.14), ("null", 30, None), ("null", 45, 0.14), ("nan", 0, 0.0), ("nan", 15, float("nan"))]
    put(spark.createDataFrame([(d, at(s), r) for d, s, r in rows], schema), source)
    build = lambda r: stream_canary(r, 0.05, 4)
    found = run_to_end("verdicts", build, (stream(spark, source, schema), "ts", {"deployment": "-", "ratio": 0.0})).collect()
    assert {r["deployment"]: (r["verdict"], r["samples"]) for r in found} == {"null": ("ROLLBACK_AVG", 2), "nan": ("ROLLBACK_SPIKE", 2)}


def test_index_of_two_runs(spark):
    """A packet in two micro-batches and in two checkpoints is one row; the newest run's values count."""
    packets = packet_frame(spark, [r[0] for r in SANITIZED])
    root, dlq = scratch_path(spark, "root"), scratch_path(spark, "dlq")
    for run, model in enumerate(("m1", "m2")):
        source = scratch_path(spark, "in")
        for part in (packets, packets.where("id % 2 = 0")):
            put(part, source)
        options = {"id_column": "id", "model_version": model, "now": at(run)}
        drain(stream_index(stream(spark, source, PACKET), root, "v1", dlq, scratch_path(spark, "ckpt"), "docs", **options))
    want = enrich(packets, id_column="id", model_version="m2", now=at(1), schema_version="v1").ok
    assert same(read_index(spark, root, alias="docs"), want.select(*read_index(spark, root, "v1").columns))
