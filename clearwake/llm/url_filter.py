"""URL verdicts: host and path rules, then a list of URLs behind a blocked Bloom filter.

A filter of 256-bit blocks is built with aggregations and broadcast; its size is bounded whatever the list
holds. Only URLs that it lets pass meet the list in an exact join, which removes false hits.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.plans.registry import table

# The rules (host, path, verdict) and the host labels whose pages make up the list.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
LISTED_LABELS = ("adult-x", "casino-win", "spam-farm")

KEYS_PER_BLOCK = 16
#: Longer lists fill the blocks further: more URLs then reach the exact join, the broadcast stays.
MAX_BLOCKS = 1 << 18
_WORDS = range(4)


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (lower case) and path; both empty for a null URL or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: str = "url") -> Column:
    """Host without ``www.`` or ``m.`` and default port, path without a closing slash, and the sorted
    parameters other than tracking ones. Scheme and fragment don't count. Null without a host."""
    host, path = host_path(url)
    bare = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(F.regexp_extract(F.col(url), r"^([^#]*)", 1), r"\?([\s\S]*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref="))
    )
    return F.when(
        host != "",
        F.concat(bare, F.regexp_replace(path, r"/+$", ""), F.lit("?"), F.array_join(kept, "&")),
    )


def rule_column(field: int, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Of the rules that fit, the longest one's text (field 0) or verdict (field 1)."""
    found = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, (host + path, verdict)[field]).otherwise(found)
    return found


def _place(blocks: int, key: str = "canonical") -> list[Column]:
    """The block of a key and its bits in each of the block's four words."""
    bits = [
        F.expr(
            f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 7), {12 * w}) & 63 as int))"
            f" | shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 7), {12 * w + 6}) & 63 as int))"
        ).alias(f"bits{w}")
        for w in _WORDS
    ]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *bits]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows: ``block`` and four words of 64 bits; empty blocks have no row."""
    return listed.select(*_place(blocks)).groupBy("block").agg(
        *(F.bit_or(f"bits{w}").alias(f"word{w}") for w in _WORDS)
    )


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages`` (``page_id, url``).

    ``listed`` has a column ``canonical``; nulls and repeats in it don't matter. The longest fitting rule
    decides; without one, listed URLs are blocked and others allowed. A null URL, or one without ``://``,
    has an empty host and path and is allowed. Repeated rows are each judged.
    """
    listed = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    blocks = min(max_blocks, max(1, -(-listed.count() // KEYS_PER_BLOCK)))
    host, path = host_path()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), canonical().alias("canonical"))
    probed = urls.select("*", *_place(blocks)).join(F.broadcast(bloom_blocks(listed, blocks)), "block", "left")
    hit = F.lit(True)
    for w in _WORDS:
        hit = hit & (F.col(f"word{w}").bitwiseAND(F.col(f"bits{w}")) == F.col(f"bits{w}"))
    probed = probed.select(
        "page_id", "host", "path", "canonical", F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)).alias("maybe")
    )
    possible = probed.where("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    columns = ["page_id", "host", "path"]
    both = possible.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(
        probed.where(~F.col("maybe")).select(*columns, F.lit(False).alias("listed"))
    )
    return both.select(
        *columns,
        rule_column(0, rules).alias("rule"),
        F.coalesce(rule_column(1, rules), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


def listed_urls(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS) -> DataFrame:
    """The list: canonical URLs of pages on hosts with one of the labels."""
    host, _ = host_path()
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))).select(
        canonical().alias("canonical")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, listed_urls(pages))


SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(regexp_extract(url, '^([^#]*)', 1), '\?((?s:.*))$', 1), '&'),
           lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS params
  FROM parts),
urls AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
           || regexp_replace(path, '/+$', '') || '?' || array_to_string(params, '&') END AS canonical
  FROM split),
listed AS (
  SELECT DISTINCT canonical FROM urls
  WHERE list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'spam-farm']) AND canonical IS NOT NULL),
judged AS (
  SELECT page_id, host, path, listed.canonical IS NOT NULL AS listed,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM urls LEFT JOIN listed USING (canonical))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""
