"""Links, crawl frontier and lineage over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.functions.packets import parse_raw_packet
from clearwake.functions.urls import host_of, is_interesting_link
from clearwake.operators.crawl import (
    allow_domains,
    crawl_snapshot,
    dedupe_frontier,
    extract_links,
    page_budget,
    resolve_links,
    to_envelopes,
)
from clearwake.operators.lineage import ingest_latency, latency_p95, lost_packets, trace_lineage
from clearwake.operators.sanitize import classify_raw
from clearwake.plans.inputs import CLASSIFIED, EPOCH, SQL_HIDDEN, TRACEPARENT, moment, raw_envelopes
from clearwake.plans.registry import query, table, wide_table
from clearwake.plans.text_plans import PAGE_MIN_BYTES
from clearwake.session import cut_lineage

_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)"""
_LINKS = f"""
raw_links AS (
  SELECT page_id, url, regexp_extract_all(regexp_replace(html, '{SQL_HIDDEN}', '', 'g'), '{_HREF}', 1) AS found FROM pages),
links AS (
  SELECT page_id, url, position - 1 AS position,
         trim(replace(regexp_replace(found[position], '^["'']|["'']$', '', 'g'), '&amp;', '&')) AS href
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS position FROM raw_links))"""
_BLOCKED = " OR ".join(
    f"contains(lower(href), '{s}')"
    for s in (".png", ".jpg", ".jpeg", ".gif", ".css", ".js", ".svg", ".woff", ".woff2")
)
_INTERESTING = f"(href <> '' AND NOT starts_with(href, 'javascript:') AND NOT starts_with(href, 'mailto:') AND NOT ({_BLOCKED}))"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_links(wide_table(spark, sf_dir, "pages", "page_id"))


@query("links", f"WITH {_LINKS} SELECT page_id, position, href FROM links")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select("page_id", "position", "href")


def varied_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links in every written form: the site's own hrefs are all root-relative."""
    href, kind = F.col("href"), F.col("position") % 12
    varied = (
        F.when(kind == 1, F.concat(F.lit("https://other.example.org"), href))
        .when(kind == 2, F.concat(F.lit("//cdn.example.net"), href))
        .when(kind == 3, F.concat(F.lit("?q="), F.col("position").cast("string")))
        .when(kind == 4, F.concat(F.lit("dir/./a/../"), F.substr(href, F.lit(2))))
        .when(kind == 5, F.concat(F.lit("#"), F.substr(href, F.lit(2))))
        .when(kind == 6, F.lit("javascript:void(0)"))
        .when(kind == 7, F.lit("mailto:a@b.example"))
        .when(kind == 8, F.concat(href, F.lit(".PNG?x=1")))
        .when(kind == 9, F.lit("/data.json"))
        .when(kind == 10, F.lit(""))
        .when(kind == 11, F.concat(href, F.lit("#part")))
        .otherwise(href)
    )
    return page_links(spark, sf_dir).withColumn("href", varied)


_VARIED = f"""{_LINKS},
varied AS (
  SELECT page_id, url, position, CASE position % 12
    WHEN 1 THEN 'https://other.example.org' || href WHEN 2 THEN '//cdn.example.net' || href
    WHEN 3 THEN '?q=' || CAST(position AS VARCHAR) WHEN 4 THEN 'dir/./a/../' || substr(href, 2)
    WHEN 5 THEN '#' || substr(href, 2) WHEN 6 THEN 'javascript:void(0)' WHEN 7 THEN 'mailto:a@b.example'
    WHEN 8 THEN href || '.PNG?x=1' WHEN 9 THEN '/data.json' WHEN 10 THEN '' WHEN 11 THEN href || '#part'
    ELSE href END AS href, href AS own,
    regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path
  FROM links),
absolute AS (
  SELECT page_id, position, href, CASE position % 12
    WHEN 1 THEN 'https://other.example.org' || own
    WHEN 2 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example.net' || own
    WHEN 3 THEN origin || path || '?q=' || CAST(position AS VARCHAR)
    WHEN 4 THEN origin || regexp_replace(path, '[^/]*$', '') || 'dir/' || substr(own, 2)
    WHEN 5 THEN NULL ELSE origin || regexp_replace(own, '#.*$', '') END AS link
  FROM varied WHERE {_INTERESTING})"""


@query("interesting_links", f"WITH {_VARIED} SELECT page_id, position, href, {_INTERESTING} AS interesting FROM varied")
def interesting_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_links(spark, sf_dir).select(
        "page_id", "position", "href", is_interesting_link("href").alias("interesting")
    )


@query("absolute_links", f"WITH {_VARIED} SELECT page_id, position, link FROM absolute WHERE link IS NOT NULL")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_links(varied_links(spark, sf_dir)).select("page_id", "position", "link")


_HOST = "regexp_extract({0}, '^https?://([^/?#]*)', 1)"


@query(
    "allowed_links",
    f"""WITH {_VARIED} SELECT page_id, position, link FROM absolute
WHERE {_HOST.format("link")} IN (SELECT {_HOST.format("url")} FROM pages WHERE page_id % 3 = 0)""",
)
def allowed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(host_of("url").alias("host")).distinct()
    found = resolve_links(varied_links(spark, sf_dir))
    return allow_domains(found, hosts).select("page_id", "position", "link")


@query(
    "frontier_next",
    f"""WITH {_VARIED} SELECT DISTINCT link AS url FROM absolute
WHERE link IS NOT NULL AND link NOT IN (SELECT link FROM absolute WHERE page_id % 4 = 0 AND link IS NOT NULL)""",
)
def frontier_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_links(varied_links(spark, sf_dir))
    visited = found.where("page_id % 4 = 0").select(F.col("link").alias("url"))
    return dedupe_frontier(found, visited)


@query(
    "page_budget",
    f"""WITH {_VARIED} SELECT min(position) AS depth, link AS url FROM absolute WHERE link IS NOT NULL
GROUP BY link ORDER BY depth, url LIMIT 300""",
)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_links(varied_links(spark, sf_dir)).groupBy(F.col("link").alias("url"))
    return page_budget(found.agg(F.min("position").alias("depth")), "not a number")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as one linked site: page n links to 2n+1, 2n+2 (a tree), back to n-3, to a picture
    and to other hosts."""
    n = F.col("page_id")

    def anchor(path) -> F.Column:
        return F.concat(F.lit('<a href="'), path, F.lit('">x</a>'))

    extra = F.concat(
        anchor(F.concat(F.lit("/p/"), (n * 2 + 1).cast("string"))),
        anchor(F.concat(F.lit("https://site.example/p/"), (n * 2 + 2).cast("string"), F.lit("#top"))),
        anchor(F.concat(F.lit("../p/"), F.greatest(n - 3, F.lit(0)).cast("string"))),
        anchor(F.lit("/logo.png")),
        anchor(F.concat(F.lit("https://elsewhere.example/p/"), n.cast("string"))),
    )
    return wide_table(spark, sf_dir, "pages", "page_id").select(
        F.concat(F.lit("https://site.example/p/"), n.cast("string")).alias("url"),
        F.concat(F.col("html"), extra).alias("html"),
    )


_CRAWL = """
WITH RECURSIVE edge AS (
  SELECT page_id AS src, unnest([page_id * 2 + 1, page_id * 2 + 2, greatest(page_id - 3, 0)]) AS dst FROM pages),
walk(page_id, depth) AS (
  SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION
  SELECT e.dst, w.depth + 1 FROM walk w JOIN edge e ON e.src = w.page_id JOIN pages p ON p.page_id = e.dst
  WHERE w.depth < 40 AND e.dst > w.page_id)
SELECT 'https://site.example/p/' || CAST(page_id AS VARCHAR) AS url, min(depth) AS depth FROM walk GROUP BY page_id"""


@query("crawl_bfs", _CRAWL)
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl of the whole site; forward links alone give the shortest paths of this one."""
    pages = site_pages(spark, sf_dir)
    found = crawl_snapshot(pages, "https://site.example/p/0", "site.example, ", max_pages=2**31 - 2)
    return found.select("url", "depth")


@query(
    "crawl_budget",
    f"""SELECT url, depth, {TRACEPARENT.format("url")} AS traceparent FROM ({_CRAWL}) ORDER BY depth, url LIMIT 40""",
)
def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that stops at its budget, as raw packets read back."""
    found = crawl_snapshot(site_pages(spark, sf_dir), "https://site.example/p/0", ["site.example"], max_pages=40)
    packets = to_envelopes(found, F.to_timestamp(F.lit(EPOCH)))
    depths = found.select("url", "depth")
    read = parse_raw_packet(packets).select(F.col("source_url").alias("url"), "traceparent")
    return depths.join(read, "url")


# -- lineage -------------------------------------------------------------------------------------


def stages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Raw, sanitized, index and dead-letter rows; every seventh packet is not indexed."""
    classified = classify_raw(raw_envelopes(spark, sf_dir), PAGE_MIN_BYTES)
    collected = F.try_to_timestamp("collected_at").alias("collected_at")
    # stage tables are stored where they are made, so packets are parsed once
    raw = cut_lineage(classified.select("page_id", "traceparent", collected, "outcome"))
    clean = raw.where("outcome = 'ok'").select("page_id", "traceparent")
    lost = F.col("page_id") % 7 == 0
    index = clean.where(~lost).withColumn(
        "timestamp", moment(F.col("page_id") + 30 + (F.col("page_id") * 37) % 150)
    )
    dlq = clean.where(lost & (F.col("page_id") % 2 == 0))
    return raw, clean, index, dlq


_STAGES = f"""{CLASSIFIED},
traced AS (SELECT page_id, outcome, CASE WHEN length(traceparent) = 55 THEN split_part(traceparent, '-', 2) END AS trace_id
           FROM classified)"""


@query(
    "trace_lineage",
    f"""WITH {_STAGES}, flags AS (
  SELECT trace_id, 1 AS raw_packets, CAST(outcome = 'ok' AS INT) AS sanitized_packets,
         CAST(outcome = 'ok' AND page_id % 7 <> 0 AS INT) AS index_packets,
         CAST(outcome = 'ok' AND page_id % 14 = 0 AS INT) AS dlq_packets FROM traced WHERE trace_id IS NOT NULL)
SELECT *, CASE WHEN index_packets = 1 THEN 'indexed' WHEN dlq_packets = 1 THEN 'dead_letter'
               WHEN sanitized_packets = 1 THEN 'lost_before_index' ELSE 'lost_before_sanitized' END AS outcome FROM flags""",
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_lineage(*stages(spark, sf_dir)).drop("missing_stage")


@query(
    "lost_packets",
    f"""WITH {_STAGES} SELECT trace_id, 'lost_before_index' AS outcome FROM traced
WHERE trace_id IS NOT NULL AND outcome = 'ok' AND page_id % 7 = 0 AND page_id % 2 = 1
UNION ALL SELECT trace_id, 'lost_before_sanitized' FROM traced WHERE trace_id IS NOT NULL AND outcome <> 'ok'""",
)
def lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lost_packets(trace_lineage(*stages(spark, sf_dir))).select("trace_id", "outcome")


@query(
    "ingest_latency_p95",
    f"""WITH {_STAGES}, latency AS (
  SELECT page_id % 3 AS worker, 30 + (page_id * 37) % 150 AS latency_s FROM traced
  WHERE trace_id IS NOT NULL AND outcome = 'ok' AND page_id % 7 <> 0)
SELECT worker, count(*) AS n, round(quantile_cont(latency_s, 0.95), 6) AS p95_s,
       quantile_cont(latency_s, 0.95) < 120 AS within_objective FROM latency GROUP BY worker""",
)
def ingest_latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _, index, _ = stages(spark, sf_dir)
    keyed = index.withColumn("worker", F.col("page_id") % 3)
    found = latency_p95(ingest_latency(raw, keyed, keep=["worker"]), ["worker"])
    return found.withColumn("p95_s", F.round("p95_s", 6))
