"""Links, URL resolution and the crawl over a stored link graph."""

import pytest

from clearwake.functions.trace import make_traceparent, parse_traceparent, random_traceparent, valid_trace_id
from clearwake.functions.urls import host_of, hrefs, is_interesting_link, with_absolute
from clearwake.operators.crawl import (
    allow_domains,
    crawl_snapshot,
    extract_links,
    page_limit,
    parse_domains,
    resolve_links,
    to_envelopes,
)
from clearwake.functions.packets import parse_raw_packet
from clearwake.operators.lineage import ingest_latency, latency_p95, lost_packets, trace_lineage
from pyspark.sql import functions as F
import datetime

LINKS = {
    "": False,
    "mailto:test@example.com": False,
    "javascript:void(0)": False,
    "JavaScript:void(0)": True,
    "https://example.org/file.png": False,
    "https://example.org/FILE.PNG?x=1": False,
    "https://example.org/data.json": False,
    "https://example.org/page": True,
}


def test_interesting_links(spark):
    df = spark.createDataFrame([(x,) for x in (*LINKS, None)], "l string")
    assert [r[0] for r in df.select(is_interesting_link("l")).collect()] == [*LINKS.values(), False]


BASE = "https://a.test:8080/x/y.html?q=1#f"
RESOLVED = {
    "https://b.test/p": "https://b.test/p",
    "//b.test/p": "https://b.test/p",
    "/p?x=1#top": "https://a.test:8080/p?x=1",
    "p": "https://a.test:8080/x/p",
    "./p": "https://a.test:8080/x/p",
    "../p": "https://a.test:8080/p",
    "../../../p": "https://a.test:8080/p",
    "a/b/../../p/.": "https://a.test:8080/x/p/",
    "..": "https://a.test:8080/",
    "/a/./b/..": "https://a.test:8080/a/",
    "?z=..": "https://a.test:8080/x/y.html?z=..",
    "#part": None,
    "ftp://b.test/p": None,
    "tel:123": None,
    "p/..hidden/..": "https://a.test:8080/x/p/",
}


def test_resolution(spark):
    df = spark.createDataFrame([(i, BASE, h) for i, h in enumerate(RESOLVED)], "i int, base string, href string")
    got = [r["out"] for r in with_absolute(df, "base", "href", "out").orderBy("i").collect()]
    assert got == list(RESOLVED.values())


def test_resolution_needs_an_absolute_base(spark):
    df = spark.createDataFrame([("a/b", "c"), ("https://h", "c"), (None, "c")], "base string, href string")
    assert {r["base"]: r["out"] for r in with_absolute(df, "base", "href", "out").collect()} == {"a/b": None, "https://h": "https://h/c", None: None}


def test_anchors(spark):
    html = """<a href="/one">1</a><A class=x HREF='/two?a=1&amp;b=2'>2</A><a href=/three>3</a><a name="x">no</a>
      <a data-href="/no">no</a><!-- <a href="/no">no</a> --><script>'<a href="/no">'</script><link href="/no"><a href="">e</a>"""
    rows = extract_links(spark.createDataFrame([(1, "https://a.test/d/", html)], "page_id long, url string, html string"))
    assert [r["href"] for r in rows.orderBy("position").collect()] == ["/one", "/two?a=1&b=2", "/three", ""]
    based = '<base href="/other/"><a href="p">x</a>'
    found = extract_links(spark.createDataFrame([(1, "https://a.test/d/", based)], "page_id long, url string, html string"))
    assert resolve_links(found).first()["link"] == "https://a.test/other/p"


def test_domains(spark):
    df = spark.createDataFrame([(u,) for u in ("https://a.test/x", "https://b.test/", "https://sub.a.test/", "http://a.test:80/")], "link string")
    assert parse_domains(" a.test , ,b.test,") == ["a.test", "b.test"]
    want = {"https://a.test/x", "https://b.test/"}
    assert {r[0] for r in allow_domains(df, " a.test , ,b.test,").collect()} == want
    assert {r[0] for r in allow_domains(df, spark.createDataFrame([("a.test",), ("b.test",)], "host string")).collect()} == want
    assert allow_domains(df, "").count() == 0
    assert df.select(host_of("link")).collect()[3][0] == "a.test:80"
    with pytest.raises(ValueError):
        allow_domains(df, [str(i) for i in range(2_000)])


def test_page_limit():
    assert [page_limit(v) for v in (7, "12", " 9 ", 0, -1, "x", None, "")] == [7, 12, 9, 300, 300, 300, 300, 300]


GRAPH = {
    "https://a.test/": '<a href="b">b</a><a href="/c">c</a><a href="b">again</a><a href="/x.png">p</a>',
    "https://a.test/b": '<a href="/">cycle</a><a href="d">d</a><a href="https://off.test/z">off</a>',
    "https://a.test/c": '<a href="b">b</a><a href="/missing">m</a><a href="/e?x=1#f">e</a>',
    "https://a.test/d": '<a href="/e?x=1">e</a>',
    "https://a.test/e?x=1": '<a href="mailto:x@y">m</a><a href="javascript:1">j</a><a href="/deep">deep</a>',
    "https://a.test/deep": "end",
    "https://a.test/island": '<a href="/">home</a>',
    "https://off.test/z": '<a href="https://a.test/island">i</a>',
}
DEPTHS = {"https://a.test/": 0, "https://a.test/b": 1, "https://a.test/c": 1, "https://a.test/d": 2, "https://a.test/e?x=1": 2, "https://a.test/deep": 3}


def crawl(spark, **options):
    pages = spark.createDataFrame(list(GRAPH.items()), "url string, html string")
    return crawl_snapshot(pages, options.pop("start", "https://a.test/"), "a.test", **options)


def test_crawl(spark):
    found = crawl(spark)
    assert {r["url"]: r["depth"] for r in found.collect()} == DEPTHS
    assert {r["url"]: r["html"] for r in found.collect()} == {u: GRAPH[u] for u in DEPTHS}


def test_crawl_limits(spark):
    def urls(**options):
        return [r["url"] for r in crawl(spark, **options).orderBy("depth", "url").collect()]

    assert urls(max_pages=4) == list(DEPTHS)[:4]
    assert urls(max_depth=1) == [u for u, d in DEPTHS.items() if d <= 1]
    assert urls(max_depth=0) == ["https://a.test/"]
    assert urls(start="https://off.test/z") == [] and urls(start="https://a.test/nowhere") == []


def test_crawl_hub(spark):
    """A target that every page links to is visited once; a page stored twice is one page."""
    rows = [(f"https://a.test/{i}", f'<a href="/hub">h</a><a href="/{i + 1}">n</a>') for i in range(6)]
    rows += [("https://a.test/hub", '<a href="/0">b</a>')] * 5
    found = crawl_snapshot(spark.createDataFrame(rows, "url string, html string"), "https://a.test/0", ["a.test"])
    assert sorted((r["url"], r["depth"]) for r in found.collect()) == sorted(
        [(f"https://a.test/{i}", i) for i in range(6)] + [("https://a.test/hub", 1)]
    )


def test_envelopes(spark):
    read = parse_raw_packet(to_envelopes(crawl(spark, max_depth=0), F.lit("2024-01-01").cast("timestamp"))).first()
    assert read["source_url"] == "https://a.test/" and read["html"] == GRAPH["https://a.test/"]
    assert read["collected_at"] == "2024-01-01T00:00:00.000000Z" and len(read["traceparent"]) == 55


def test_traceparents(spark):
    made = spark.createDataFrame([("a",), ("a",), (None,)], "k string").select(make_traceparent("k").alias("t"))
    first, second, zero = (r["t"] for r in made.collect())
    assert first == second and zero == "00-" + "0" * 32 + "-" + "0" * 16 + "-01"
    assert spark.range(1).select(make_traceparent(F.lit("a"), sampled=False)).first()[0].endswith("-00")
    drawn = [r[0] for r in spark.range(3).select(random_traceparent()).collect()]
    assert len(set(drawn)) == 3
    cases = {first: True, zero: False, "00-abc-def-01": False, None: False, "ff" + first[2:]: False, first.upper(): False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(parse_traceparent("t")["valid"]).collect()] == list(cases.values())
    assert df.select(valid_trace_id("t")).first()[0] == first[3:35]


def trace(n):
    return f"00-{n:032x}-{1:016x}-01"


def test_lineage(spark):
    def stage(*numbers):
        return spark.createDataFrame([(trace(n),) for n in numbers] + [(trace(0),), (None,)], "traceparent string")

    rows = trace_lineage(stage(1, 2, 3, 4, 1), stage(1, 2, 3), stage(1, 1, 5), stage(2))
    got = {int(r["trace_id"], 16): (r["outcome"], r["missing_stage"], r["index_packets"]) for r in rows.collect()}
    assert got == {
        1: ("indexed", None, 2),
        2: ("dead_letter", None, 0),
        3: ("lost_before_index", None, 0),
        4: ("lost_before_sanitized", None, 0),
        5: ("indexed", "raw", 1),
    }
    assert lost_packets(rows).count() == 2


def test_latency(spark):
    t0 = datetime.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(trace(n), t0) for n in (1, 2, 3, 0)], "traceparent string, collected_at timestamp")
    index = spark.createDataFrame(
        [(trace(1), t0 + datetime.timedelta(seconds=10), "m"), (trace(2), t0 + datetime.timedelta(seconds=20.5), "m"), (trace(0), t0, "m")],
        "traceparent string, timestamp timestamp, model string",
    )
    found = ingest_latency(raw, index, keep=["model"])
    assert sorted(r["latency_s"] for r in found.collect()) == [10.0, 20.5]
    row = latency_p95(found, ["model"]).first()
    assert row["p95_s"] == pytest.approx(19.975) and row["within_objective"] is True


def test_hrefs_behind_quoted_values(spark):
    html = """<a title="x>y" href="/q">1</a><a title='href="/no"' data-href=/no href = '/r'>2</a><a title="t"href=/s>3</a>
    <abbr href=/no>4</abbr><a\nclass=c\nHREF="/t">5</a><a name=x>6</a> href=/no <a x=1/href="/no">7</a>"""
    rows = spark.createDataFrame([(html,)], "html string").select(hrefs("html").alias("found"))
    assert rows.first()["found"] == ["/q", "/r", "/s", "/t"]
