"""Text expressions: trimming, markup removal, keyword and substring counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The risk keywords of the rule scorer.
RISK_KEYWORDS = (
    "password",
    "admin",
    "login",
    "secret",
    "confidential",
    "leaked",
    "db_pass",
    "key",
)

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

CONTENT_CHARS = 5_000

# One pass, leftmost first: a script or style element with its content, a comment, any tag.
# An unclosed one runs to the end of the text. ``>`` inside a quoted attribute value does not
# close a tag. Every loop is possessive, so matching neither backtracks nor recurses.
_DROPPED_ELEMENTS = (
    r"<script\b[^>]*+>.*?(?:</script\s*+>|\z)"
    r"|<style\b[^>]*+>.*?(?:</style\s*+>|\z)"
    r"|<!--.*?(?:-->|\z)"
)
_TAG = r"<[a-z/!?][^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+(?:>|\z)"
MARKUP = f"(?is){_DROPPED_ELEMENTS}|{_TAG}"
HIDDEN_MARKUP = f"(?is){_DROPPED_ELEMENTS}"

_BARE_AMPERSAND = r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)"

_WORD = r"[\p{L}\p{N}_]+"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_white(text: Column | str) -> Column:
    """Trim Unicode white space; Spark's default ``trim`` only removes U+0020."""
    return F.btrim(col_of(text), F.lit(WHITE_SPACE))


def is_blank(text: Column | str) -> Column:
    return F.octet_length(trim_white(text)) == 0


def truncate(text: Column | str, chars: int = CONTENT_CHARS) -> Column:
    """First ``chars`` code points."""
    return F.substring(col_of(text), 1, chars)


def escape_text(text: Column | str) -> Column:
    """Write text the way an HTML serializer does; entity references already there are kept."""
    out = F.replace(col_of(text), F.lit("&quot;"), F.lit('"'))
    out = F.replace(out, F.lit("&#39;"), F.lit("'"))
    out = F.replace(out, F.lit("&apos;"), F.lit("'"))
    out = F.regexp_replace(out, _BARE_AMPERSAND, "&amp;")
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def strip_html(html: Column | str) -> Column:
    """Remove every tag and all script, style and comment content; keep the text."""
    return escape_text(F.regexp_replace(col_of(html), MARKUP, ""))


def keyword_hits(text: Column | str, keywords: Sequence[str] = RISK_KEYWORDS) -> Column:
    """How many distinct keywords occur as a substring, ignoring case."""
    lowered = F.lower(col_of(text))
    if len(keywords) <= 64:
        return reduce(add, (F.contains(lowered, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    listed = F.array(*(F.lit(k.lower()) for k in keywords))
    return F.size(F.filter(listed, lambda k: F.contains(lowered, k)))


def count_substring(text: Column | str, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    value = col_of(text)
    removed = F.length(value) - F.length(F.replace(value, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")


def enriched_text(text: Column | str, entities: Column | str) -> Column:
    """Model input: the text followed by an entity-count marker."""
    return F.format_string("%s __entity_count_%d__", col_of(text), F.size(col_of(entities)))


def word_tokens(text: Column | str, min_chars: int = 1) -> Column:
    """Lower-cased maximal runs of letters, digits and underscores, in text order."""
    pattern = _WORD if min_chars == 1 else r"[\p{L}\p{N}_]{%d,}" % min_chars
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit(pattern), F.lit(0))
