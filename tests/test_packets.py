"""Packet parsing, cleaning and dead letters on edge rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_packet, parse_packet_with_meta, parse_raw_packet, to_raw_json, to_sanitized_json
from clearwake.functions.text import (
    count_substring,
    is_blank,
    keyword_hits,
    strip_html,
    trim_white,
    truncate,
    word_tokens,
)
from clearwake.operators.dlq import normalise_dlq, parse_dlq, replay
from clearwake.operators.enrich import enrich
from clearwake.operators.sanitize import classify_raw, min_length, sanitize
from clearwake.schemas import DLQ, INDEX, require_exact
from clearwake.session import cut_lineage

HELLO = "<html><body><h1>Hello</h1><p>world</p></body></html>"

# text that starts like JSON but is none as a whole
TRAILING = ('{"raw_html":"x"} y', '{"text":"x"}]', '{"text":"x"}}', "2024 was dry", "1,2,3", '1,"v":2', '"a" b', "[1] see", "nullable", "1] a", "1} a", '{"text":"a"')

# value -> html (None: the value itself), traceparent, source_url, fallback, outcome with minimum 3
RAW = [
    ('{"raw_html":"%s","source_url":"https://a","traceparent":"00-abc-def-01"}' % HELLO, HELLO, "00-abc-def-01", "https://a", False, "ok"),
    ("<p>plain</p>", None, None, None, True, "ok"),
    ('{"source_url":"https://a"}', None, None, "https://a", False, "ok"),
    ('{"raw_html":5}', None, None, None, False, "ok"),
    ('{"raw_html":"ab","source_url":7}', "ab", None, None, False, "dropped"),
    ('{"raw_html":"   "}', "   ", None, None, False, "dlq"),
    ('{"raw_html":""}', "", None, None, False, "dlq"),
    ("", None, None, None, True, "dlq"),
    ("123", None, None, None, False, "ok"),
    ("null", None, None, None, False, "ok"),
    ("[1]", None, None, None, False, "ok"),
    ("{'raw_html':'x'}", None, None, None, True, "ok"),
    ('{"raw_html":"x","raw_html":"yyyy"}', "yyyy", None, None, False, "ok"),
    *((v, None, None, None, True, "ok") for v in TRAILING),
    ('{"raw_html":"<p>é</p>"}', "<p>é</p>", None, None, False, "dropped"),
    ('{"raw_html":"<p>éé</p>"}', "<p>éé</p>", None, None, False, "ok"),
]

ENVELOPE = '{"error":"e","payload":"p","failed_at":"t","traceparent":"00-abc-def-01","source_url":"u"}'
# value -> text (None: the value itself), traceparent, source_url, fallback, quarantine
SANITIZED = [
    ("plain text", None, None, None, True, None),
    *((v, None, None, None, True, None) for v in TRAILING),
    (' {"text": "padded"}\n', "padded", None, None, False, None),
    ('{"text": "clean content"}', "clean content", None, None, False, None),
    (
        '{"text": "clean content", "traceparent": "00-abc-def-01", "source_url": "https://example.com"}',
        "clean content",
        "00-abc-def-01",
        "https://example.com",
        False,
        None,
    ),
    *((v, None, None, None, False, None) for v in ('{"text": ""}', '{"text": null}', "{}", '{"text": 0}', '{"text": false}', '{"text": []}')),
    *((v, None, None, None, False, "non_string_text") for v in ('{"text": 5}', '{"text": true}', '{"text": [0]}', '{"text": {"a": 1}}')),
    *((v, None, None, None, False, "non_object_json") for v in ("123", "null", "[1]", '"text"')),
    (ENVELOPE, None, "00-abc-def-01", "u", False, None),
]


def packets(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, value string")


def test_raw_packets(spark):
    rows = classify_raw(packets(spark, [r[0] for r in RAW]), 3).orderBy("id").collect()
    for row, (value, html, trace, url, fallback, outcome) in zip(rows, RAW, strict=True):
        assert row["html"] == (value if html is None else html)
        assert (row["traceparent"], row["source_url"], row["parse_fallback"]) == (trace, url, fallback), value
        assert row["outcome"] == outcome, value
        assert row["length"] == len(row["html"].encode())
        assert (row["error"] == "empty_raw_html") == (outcome == "dlq")


def test_sanitize_branches(spark):
    parts = sanitize(packets(spark, [r[0] for r in RAW]), 3, keep=("id",))
    ids = [[r["id"] for r in part.orderBy("id").collect()] for part in parts]
    assert ids == [[i for i, r in enumerate(RAW) if r[5] == o] for o in ("ok", "dlq", "dropped")]
    assert parts.ok.columns == ["id", "text", "length", "source_url", "traceparent"]
    hello = parts.ok.where("id = 0").first()
    assert hello["text"] == "Helloworld" and hello["length"] == len(HELLO)


def test_short_text_is_dropped(spark):
    parts = sanitize(packets(spark, ["<p>short</p>"]), 10)
    assert parts.dropped.count() == 1 and parts.ok.count() == 0 and parts.dlq.count() == 0
    assert min_length(spark.createDataFrame([(" éé ",), ("éé",), ("abc",)], "t string"), "t", 4).count() == 2


def test_sanitized_packets(spark):
    rows = parse_packet_with_meta(packets(spark, [r[0] for r in SANITIZED])).orderBy("id").collect()
    for row, (value, text, trace, url, fallback, quarantine) in zip(rows, SANITIZED, strict=True):
        expected = None if quarantine else (value if text is None else text)
        assert row["text"] == expected, value
        assert (row["traceparent"], row["source_url"], row["fallback"]) == (trace, url, fallback), value
        assert row["quarantine"] == quarantine, value


def test_parse_packet(spark):
    df = packets(spark, ["plain text", '{"text": "clean content"}', '{"text": ""}'])
    assert [r[0] for r in df.orderBy("id").select(parse_packet("value")).collect()] == ["plain text", "clean content", '{"text": ""}']


def test_packets_beyond_the_variant_limit(spark):
    filler = F.repeat(F.lit("abcdefghij"), (F.col("id") + 2_000_000).cast("int"))
    df = cut_lineage(
        spark.range(1).select(
            F.concat(F.lit('{"raw_html":"<b>'), filler, F.lit('</b>","text":"'), filler, F.lit('","source_url":"u"}')).alias("value")
        )
    )
    raw = classify_raw(df).select(F.length("text"), "parse_fallback", "source_url").first()
    assert tuple(raw) == (20_000_000, False, "u")
    text = parse_packet_with_meta(df).select(F.length("text"), "fallback", "quarantine").first()
    assert tuple(text) == (20_000_000, False, None)


def _filled(spark, shapes, chars):
    """Each shape with ``@`` replaced by so many characters, as a stored table."""
    rows = spark.createDataFrame(list(enumerate(shapes)), "id long, shape string")
    filler = F.repeat(F.lit("abcdefghij"), F.lit(chars // 10))
    return cut_lineage(rows.select("id", F.replace("shape", F.lit("@"), filler).alias("value")))


SIZED = [
    '{"raw_html":5,"text":5,"pad":"@"}',
    '{"raw_html":"5","text":"5","pad":"@"}',
    '{"raw_html":"NaN","text":"NaN","pad":"@"}',
    '{"raw_html":true,"text":true,"pad":"@"}',
    '{"raw_html":[1],"text":["x"],"pad":"@"}',
    '{"raw_html":{"a":1},"text":{"a":1},"pad":"@"}',
    '{"raw_html":null,"text":null,"pad":"@"}',
    '{"raw_html":"","text":"","pad":"@"}',
    '{"text":0,"pad":"@"}',
    '{"text":false,"pad":"@"}',
    '{"text":[],"pad":"@"}',
    '{"text":{},"pad":"@"}',
    '{"pad":"@","source_url":"u"}',
    '["@"]',
    '"@"',
    '{"text":"x","pad":"@"} more',
    "{'text':'x','pad':'@'}",
    "@",
]


def test_size_changes_no_rule(spark):
    """The same packets at 100,000 and 20,000,000 characters."""

    def outcomes(chars):
        df = _filled(spark, SIZED, chars)
        same_html, same_text = F.col("html") == F.col("value"), F.col("text") == F.col("value")
        raw = parse_raw_packet(df).select("id", F.when(same_html, "whole").otherwise(F.col("html")), "source_url", "parse_fallback")
        clean = parse_packet_with_meta(df).select(
            "id", F.when(same_text, "whole").otherwise(F.col("text")), "source_url", "fallback", "quarantine"
        )
        return sorted(map(tuple, raw.collect())), sorted(map(tuple, clean.collect()))

    small, big = outcomes(100_000), outcomes(20_000_000)
    assert big == small
    assert small[1][0][1:] == (None, None, False, "non_string_text")


def test_big_dead_letters(spark):
    df = _filled(spark, ['{"error":"e","payload":"@","failed_at":"2024-01-01T00:00:00Z"}', '{"error":5,"raw_payload":"@"}'], 20_000_000)
    rows = parse_dlq(df, "collector", keep=("id",)).select("id", "error", F.length("payload"), F.col("failed_at").isNotNull())
    assert sorted(map(tuple, rows.collect())) == [(0, "e", 20_000_000, True), (1, None, 20_000_000, False)]


def test_packet_round_trip(spark):
    row = spark.createDataFrame([("<b>x</b>", "u", "2024-01-01T00:00:00Z", None)], "raw_html string, source_url string, collected_at string, traceparent string")
    back = parse_raw_packet(row.select(to_raw_json().alias("value"))).first()
    assert (back["html"], back["source_url"], back["collected_at"], back["traceparent"]) == ("<b>x</b>", "u", "2024-01-01T00:00:00Z", None)
    clean = spark.createDataFrame([("t", 3, None, None)], "text string, length long, source_url string, traceparent string")
    assert clean.select(to_sanitized_json()).first()[0] == '{"text":"t","length":3,"source_url":null,"traceparent":null}'


HTML = {
    "a<b>c</b> x < y & z &amp; &eacute;": "ac x &lt; y &amp; z &amp; &eacute;",
    'p<script>var a="</p>";</script>q<style>p{}</style><!-- <b>no</b> -->r': "pqr",
    '<a title="a>b" href=x>link</a>tail': "linktail",
    "<SCRIPT type='x'>no</SCRIPT >yes": "yes",
    "t<script>unclosed <b>": "t",
    "t<!-- unclosed": "t",
    "t<b class='x": "t",
    '<a href="x"">q</a>z': "qz",
    "<!DOCTYPE html><?xml a?>x</3>y": "xy",
    "&quot;q&quot; &#39;a&#39;": "\"q\" 'a'",
    "<p " + 'a="b>" ' * 20_000 + ">done": "done",
    "<p" + "=" * 20_000 + ">done": "done",
    "<" * 20_000: "&lt;" * 20_000,
}


def test_strip_html(spark):
    df = packets(spark, list(HTML))
    assert [r[0] for r in df.orderBy("id").select(strip_html("value")).collect()] == list(HTML.values())


def test_text_expressions(spark):
    def one(expression):
        return spark.range(1).select(expression).first()[0]

    assert one(trim_white(F.lit(" 　 \n a b\t\x0b\x85"))) == "a b"
    assert one(is_blank(F.lit("  \n"))) is True
    assert one(truncate(F.lit("é𝄞abc"), 2)) == "é𝄞"
    assert one(keyword_hits(F.lit("KEY key Key"))) == 1
    assert one(keyword_hits(F.lit("x y"), [f"w{i}" for i in range(99)] + ["Y"])) == 1
    assert one(count_substring(F.lit("http://http"), "http")) == 2
    assert one(count_substring(F.lit("aaaa"), "aa")) == 2
    assert one(word_tokens(F.lit("Ab, c_1 é-x"), 2)) == ["ab", "c_1"]


def test_dlq_shapes(spark):
    shapes = [
        ("collector", '{"error":"e","raw_payload":"p","failed_at":"2024-01-01T00:00:01.5Z"}'),
        ("sanitizer", '{"error":"e","raw_payload":"p"}'),
        ("sanitizer", '{"error":"e","raw_payload":"p","failed_queue":"q"}'),
        ("brain", '{"error":"e","payload":"p","failed_at":"2024-01-01T00:00:00Z","traceparent":"t","source_url":"u"}'),
    ]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(shapes)], "id long, stage string, value string")
    letters = parse_dlq(df, None, keep=("id",)).orderBy("id")
    require_exact(letters.drop("id").schema, DLQ)
    rows = letters.collect()
    assert {r["payload"] for r in rows} == {"p"} and [r["stage"] for r in rows] == [s for s, _ in shapes]
    assert rows[0]["failed_at"] == datetime.datetime(2024, 1, 1, 0, 0, 1, 500000)
    assert rows[1]["failed_at"] is None and rows[2]["failed_queue"] == "q"
    assert (rows[3]["traceparent"], rows[3]["source_url"]) == ("t", "u")


def test_replay(spark):
    rows = [(i, "brain", "e", f"p{i}", datetime.datetime(2024, 1, 1 + i % 3) if i else None) for i in range(7)]
    dlq = normalise_dlq(
        spark.createDataFrame(rows, "id long, stage string, error string, payload string, failed_at timestamp"), keep=("id",)
    )
    parts = replay(dlq, 3)
    assert sorted(r["id"] for r in parts.replayed.collect()) == [0, 3, 6]
    assert sorted(r["id"] for r in parts.remaining.collect()) == [1, 2, 4, 5]
    assert parts.replayed.where("id = 3").first()["value"] == "p3"
    everything = replay(dlq, 50)
    assert everything.replayed.count() == 7 and everything.remaining.count() == 0
    assert replay(dlq.limit(0), 5).replayed.count() == 0
    with pytest.raises(ValueError):
        replay(dlq, 0)


def test_replay_without_unwrapping_scores_the_envelope(spark):
    dlq = normalise_dlq(spark.createDataFrame([(1, "e", "p", "t", "u")], "id long, error string, payload string, traceparent string, source_url string"), "brain", keep=("id",))
    again = parse_packet_with_meta(replay(dlq, 1, unwrap=False).replayed).first()
    assert again["text"].startswith('{"error":"e","payload":"p"') and again["traceparent"] == "t"


def test_enrich_keys_and_quarantine(spark):
    df = packets(spark, ['{"text": "password admin", "source_url": "u"}', "[1]", "plain", "plain"])
    now = datetime.datetime(2024, 5, 1)
    parts = enrich(df, model_version="m1", schema_version="v9", now=now)
    require_exact(parts.ok.schema, INDEX)
    rows = {r["content"]: r for r in parts.ok.collect()}
    assert rows["password admin"]["risk_score"] == 20 and rows["password admin"]["risk_label"] == "HIGH"
    assert (rows["plain"]["schema_version"], rows["plain"]["model_version"], rows["plain"]["timestamp"]) == ("v9", "m1", now)
    # the same packet twice has one key
    assert parts.ok.select("id").distinct().count() == 2
    assert [r["error"] for r in parts.dlq.collect()] == ["non_object_json"]
    with pytest.raises(TypeError):
        enrich(df)
