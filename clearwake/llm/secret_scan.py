"""Secret scans: fixed patterns, and strings that a tokenizer can hardly shorten.

A string of random characters has few characters per token under a vocabulary made from text. Long
strings below a ratio are reported, of mixed characters, letters or digits, unless they are digests of a known length or
UUIDs. Names are strings of words or of a few digits; their ratio is that of the words, and it must be lower. A string is
reported as a whole if only one part of it, between separators, is random.
One linear pattern over a whole batch picks the texts that are looked at further.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table

# The kinds in their order, patterns, and the least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters per token below which a string counts as random; made of words, which have rare ones among them, lower.
MAX_RATIO, MAX_WORD_RATIO = 2.2, 2.0
#: Characters that a part between separators has at least to be tested alone; of digits only as many as a candidate.
MIN_PART, MIN_DIGITS = 16, 20
# Lengths of hexadecimal digests (MD5, SHA-1, SHA-2).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PURE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Parts of words or of a few digits joined by separators, as in names and paths.
_NAME = re.compile(r"[-_/+=]*([A-Za-z]+[0-9]{0,4}|[0-9]{1,8})([-_/+=]+([A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[-_/+=]*")
_SEPARATOR = re.compile("[-_/+=]+")
# What any of the patterns needs, for a linear matcher.
_ANY = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}"
)


@lru_cache(maxsize=4)
def encoding(path: str | None):
    """The tiktoken vocabulary of a rank file; by default the installed public one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as ranks:
        pairs = [line.split() for line in ranks if line.strip()]
    return tiktoken.Encoding(
        "ranks",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        special_tokens={},
    )


def _is_digest(text: str) -> bool:
    return bool(_PURE_HEX.fullmatch(text)) and len(text) in DIGEST_LENGTHS


def _below(parts: list[str], limit: float, path: str | None) -> bool:
    """Whether the parts have fewer characters per token than ``limit``, all in all."""
    encode = encoding(path).encode_ordinary
    return sum(map(len, parts)) < limit * sum(len(encode(p)) for p in parts)


def is_random(text: str, path: str | None = None) -> bool:
    """Whether a candidate, or a long part of it, takes many tokens for its length and is neither digest nor UUID."""
    if _is_digest(text) or _UUID.fullmatch(text):
        return False
    parts = [p for p in _SEPARATOR.split(text) if p]
    # separators alone are lines, and groups of a few digits are dates and numbers
    if _NAME.fullmatch(text):
        found = _below([p for p in parts if not p.isdigit()], MAX_WORD_RATIO, path)
    else:
        found = bool(parts) and _below([text], MAX_RATIO, path)
    return found or any(
        _below([p], MAX_WORD_RATIO if _NAME.fullmatch(p) else MAX_RATIO, path)
        for p in parts
        if len(p) >= (MIN_DIGITS if p.isdigit() else MIN_PART) and p != text and not _is_digest(p)
    )


def find_spans(text: str, path: str | None = None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    base, at, reached = sorted((a, b) for _, a, b in spans), 0, 0
    for m in CANDIDATE.finditer(text):
        # candidates come in order: a base span that starts before this one's end meets it if any such ends behind its start
        while at < len(base) and base[at][0] < m.end():
            reached, at = max(reached, base[at][1]), at + 1
        if reached <= m.start() and is_random(m[0], path):
            spans.append(("random", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``secrets`` (kind, start, end in code points) of every row.

    A null or empty text has none. Repeated rows are each scanned. ``vocabulary`` is the path of a rank file.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    out = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"secrets {SPANS}"])
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                for row in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _ANY))).tolist():
                    spans = find_spans(texts[row].as_py(), vocabulary)
                    found[row] = [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).cast(schema.field(c).type) for c in keep),
                        pa.array(found, schema.field("secrets").type),
                    ],
                    schema=schema,
                )

    return docs.select(*columns).mapInArrow(run, out)


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans by one."""
    # a struct keeps the columns apart from the operator's own
    found = scan_secrets(docs.select(F.struct(*docs.columns).alias("row"), "text"), ("row", "text"), vocabulary)
    # by start: each step keeps what stands between the furthest end so far and the next span
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(state, span):
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        first = (state["at"] == 0) & (state["text"] == "")
        return F.struct(
            F.when(fresh | first, F.concat(state["text"], gap, F.lit(mark))).otherwise(state["text"]).alias("text"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    def finish(state):
        return F.concat(state["text"], F.substring(F.col("text"), state["at"] + 1, F.char_length("text")))

    cleaned = F.when(F.size("secrets") > 0, F.aggregate("secrets", start, step, finish)).otherwise(F.col("text"))
    return found.select(F.col("row").withField("text", cleaned).alias("row")).select("row.*")


def digest_columns(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_columns(scan_secrets(docs, ("doc_id",)))
