"""Link extraction and crawl frontier over a stored page snapshot."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.packets import to_raw_json
from clearwake.functions.trace import make_traceparent
from clearwake.functions.urls import base_href, host_of, hrefs, is_interesting_link, with_absolute
from clearwake.session import cut_lineage

MAX_PAGES = 300
# Domain lists longer than this are joined as a table.
MAX_LITERAL_DOMAINS = 1_000
# A frontier of more URLs than this is joined by shuffle.
BROADCAST_URLS = 100_000
# Stored tables of visited pages before they are stored as one.
LAYERS = 8


def extract_links(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per anchor with an ``href``, in document order (``position`` from 0)."""
    based = with_absolute(pages.withColumn("_base_href", base_href("html")), "url", "_base_href", "_base")
    return based.select(
        *keep,
        F.coalesce("_base", "url").alias("base_url"),
        F.posexplode(hrefs("html")).alias("position", "href"),
    )


def resolve_links(links: DataFrame) -> DataFrame:
    """Interesting links that resolve to an http(s) URL, as ``link``."""
    interesting = links.where(is_interesting_link("href"))
    return with_absolute(interesting, "base_url", "href", "link").where("link IS NOT NULL")


def parse_domains(setting: str) -> list[str]:
    """A comma-separated setting: trimmed, empty parts dropped."""
    return [part.strip() for part in setting.split(",") if part.strip()]


def allow_domains(links: DataFrame, domains: str | Iterable[str] | DataFrame, url: str = "link") -> DataFrame:
    """Links whose host is exactly one of ``domains``.

    A setting string or a short list becomes an ``IN`` filter. A DataFrame with a ``host``
    column becomes a semi join; Spark broadcasts it if its size allows.
    """
    host = host_of(url)
    if isinstance(domains, DataFrame):
        return links.withColumn("host", host).join(domains.select("host"), "host", "left_semi").drop("host")
    listed = parse_domains(domains) if isinstance(domains, str) else list(domains)
    if len(listed) > MAX_LITERAL_DOMAINS:
        raise ValueError("pass a long domain list as a DataFrame with a host column")
    return links.where(host.isin(listed))


def dedupe_frontier(links: DataFrame, visited: DataFrame, url: str = "link") -> DataFrame:
    """Each new URL once. Duplicates collapse before the shuffle, so a popular target is one row
    per task, not one per link."""
    fresh = links.select(F.col(url).alias("url")).distinct()
    return fresh.join(visited.select("url").distinct(), "url", "left_anti")


def page_limit(max_pages: int | str | None) -> int:
    """The page budget; anything that is not a positive number means the default."""
    try:
        wanted = int(str(max_pages).strip())
    except ValueError:
        return MAX_PAGES
    return wanted if wanted > 0 else MAX_PAGES


def page_budget(df: DataFrame, max_pages: int | str | None = MAX_PAGES) -> DataFrame:
    """The first pages in (depth, url) order."""
    return df.orderBy("depth", "url").limit(page_limit(max_pages))


def crawl_snapshot(
    pages: DataFrame,
    start_url: str,
    domains: str | Iterable[str] | DataFrame,
    max_pages: int | str | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Breadth-first crawl over stored pages ``(url, html)``: ``url, depth, html``.

    A page is visited at its smallest depth, in (depth, url) order, until the budget is spent; without ``max_pages``
    there is none. Links to pages that are not stored are failed fetches: they spend no budget. Page content is
    read twice in all: once for a narrow link table, once for the visited pages. Each depth joins
    narrow tables and is stored. What was reached before is at most ``LAYERS`` stored tables, so the plan does
    not grow with the depth.
    """
    budget = None if max_pages is None else page_limit(max_pages)
    known = pages.select("url").distinct()
    links = allow_domains(resolve_links(extract_links(pages, keep=("url",))), domains)
    targets = known.withColumnRenamed("url", "link")
    edges = cut_lineage(links.select("url", "link").distinct().join(targets, "link", "left_semi"))
    seed = pages.sparkSession.range(1).select(F.lit(start_url).alias("url"))
    fresh = allow_domains(seed, domains, "url").join(known, "url", "left_semi")
    layers: list[DataFrame] = []
    visited, depth = 0, 0
    while True:
        layer = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
        size = layer.count()
        if budget is not None and size > budget - visited:
            layer, size = cut_lineage(page_budget(layer, budget - visited)), budget - visited
        layers.append(layer)
        reached = reduce(DataFrame.unionByName, layers)
        if len(layers) == LAYERS:
            reached = cut_lineage(reached)
            layers = [reached]
        visited, depth = visited + size, depth + 1
        if not size or visited == budget or (max_depth is not None and depth > max_depth):
            break
        frontier = F.broadcast(layer) if size <= BROADCAST_URLS else layer
        fresh = dedupe_frontier(edges.join(frontier, "url", "left_semi"), reached)
    return pages.join(reached, "url").groupBy("url", "depth").agg(F.min("html").alias("html"))


def to_envelopes(crawled: DataFrame, collected_at: Column | None = None) -> DataFrame:
    """Crawled pages as raw packets: ``url`` and the JSON ``value``."""
    moment = F.current_timestamp() if collected_at is None else collected_at
    return crawled.select(
        "url",
        F.col("html").alias("raw_html"),
        F.col("url").alias("source_url"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("collected_at"),
        make_traceparent("url").alias("traceparent"),
    ).select("url", to_raw_json().alias("value"))
