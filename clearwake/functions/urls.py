"""Link predicates and URL resolution."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwake.functions.staging import pin
from clearwake.functions.text import HIDDEN_MARKUP, col_of

# Schemes and substrings that make a link uninteresting.
BLOCKED_PREFIXES = ("javascript:", "mailto:")
BLOCKED_SUBSTRINGS = (".png", ".jpg", ".jpeg", ".gif", ".css", ".js", ".svg", ".woff", ".woff2")

_QUOTED = r"(\"[^\"]*\"|'[^']*'|[^\s>]+)"
# Attributes before the one looked for; ``>`` inside a quoted value does not close the tag.
_OTHERS = r"(?:[\s/=]*+(?!href\s*+=)[^\s>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
_HREF = r"(?is)<a(?=[\s/])" + _OTHERS + r"[\s/=]*+href\s*+=\s*+" + _QUOTED
_BASE_HREF = r"(?is)<base(?=[\s/])" + _OTHERS + r"[\s/=]*+href\s*+=\s*+" + _QUOTED
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def is_interesting_link(link: Column | str) -> Column:
    """Not empty, not a script or mail link, none of the blocked substrings (in any case)."""
    value = col_of(link)
    lowered = F.lower(value)
    prefixed = reduce(or_, (value.startswith(p) for p in BLOCKED_PREFIXES))
    blocked = reduce(or_, (F.contains(lowered, F.lit(s)) for s in BLOCKED_SUBSTRINGS))
    return F.coalesce((value != "") & ~prefixed & ~blocked, F.lit(False))


def _attribute_value(raw: Column) -> Column:
    unquoted = F.regexp_replace(raw, r"^[\"']|[\"']$", "")
    return F.trim(F.replace(unquoted, F.lit("&amp;"), F.lit("&")))


def hrefs(html: Column | str) -> Column:
    """Array of the ``href`` of every visible anchor, in document order."""
    visible = F.regexp_replace(col_of(html), HIDDEN_MARKUP, "")
    return F.transform(F.regexp_extract_all(visible, F.lit(_HREF), F.lit(1)), _attribute_value)


def base_href(html: Column | str) -> Column:
    """``href`` of the document's base element, or null."""
    return F.nullif(_attribute_value(F.regexp_extract(col_of(html), _BASE_HREF, 1)), F.lit(""))


def host_of(url: Column | str) -> Column:
    """Host (with port, if any) of an absolute URL."""
    return F.regexp_extract(col_of(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def _without_dot_segments(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, part)),
    )
    # a path ending in a dot segment names a folder
    closing = F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), closing)


def with_absolute(df: DataFrame, base: str, href: str, name: str) -> DataFrame:
    """Adds ``name``: the column ``href`` resolved against the column ``base``, without fragment.

    Null unless the result is http(s). The steps are separate columns, so that no part of a URL
    is taken apart more than once.
    """
    target, origin, path, resolved = (F.col(c) for c in ("_target", "_origin", "_path", "_resolved"))
    own_origin, own_path = F.col("_own_origin"), F.col("_own_path")
    split = df.withColumns(
        {
            "_target": F.regexp_replace(href, "#.*$", ""),
            "_origin": F.regexp_extract(base, _ORIGIN, 1),
            "_path": F.regexp_extract(base, _PATH, 1),
        }
    )
    folder = F.regexp_replace(path, "[^/]*$", "")
    joined = split.withColumn(
        "_resolved",
        F.when(F.col(href).startswith("#"), F.lit(None))
        .when(target.rlike(_SCHEME), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]*:)", 1), target))
        .when(origin == "", F.lit(None))
        .when(target == "", F.regexp_replace(base, "#.*$", ""))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target)),
    )
    parts = joined.withColumns(
        {"_own_origin": F.regexp_extract(resolved, _ORIGIN, 1), "_own_path": F.regexp_extract(resolved, _PATH, 1)}
    )
    rest = F.substr(resolved, F.length(own_origin) + F.length(own_path) + 1)
    dotted = (own_origin != "") & own_path.rlike(r"(^|/)\.\.?(/|$)")
    clean = F.when(dotted, F.concat(own_origin, _without_dot_segments(own_path), rest)).otherwise(resolved)
    done = parts.withColumn(name, F.when(resolved.startswith("http"), clean)).drop(
        "_target", "_origin", "_path", "_resolved", "_own_origin", "_own_path"
    )
    return pin(done, name)
