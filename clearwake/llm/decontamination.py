"""Benchmark decontamination: broadcast n-gram hashes, scan whole texts, verify hits, remove spans or documents.

The test windows are collected to the driver in parts of a fixed size and broadcast one part at a time,
so a larger benchmark means more scans, not a larger broadcast. Documents are scanned where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table
from clearwake.session import cut_lineage

WINDOW = 10
#: Benchmark items in one broadcast; an item's text is a few kilobytes at most in public benchmarks.
PART_BYTES = 16 << 20
_FILTER_BITS = 20


@dataclass
class TestWindows:
    """Windows of one part of the benchmark, sorted by length and hash."""

    #: for each window length: sorted hashes, the words of each window (as numbers), its items
    by_size: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]]]]
    #: numbers of words
    numbers: dict[bytes, int]
    #: bits of the hashes that occur, for a first look
    present: dict[int, np.ndarray]


def test_windows(items: list[tuple[str, str]], size: int = WINDOW) -> TestWindows:
    """Windows of ``size`` words of each item; an item of fewer words is one window of its own length."""
    numbers: dict[bytes, int] = {}
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        raw, offsets = wa.text_bytes(pa.array([text], pa.large_string()))
        split = wa.split_words(raw, offsets, wa.ALNUM, wa.LOWER)
        words = [split.vocabulary[c].as_py() for c in split.codes.tolist()]
        for i in range(max(1, len(words) - size + 1)) if words else ():
            found.setdefault(tuple(words[i : i + size]), set()).add(item_id)
    by_size, present = {}, {}
    for length in sorted({len(w) for w in found}):
        chosen = [w for w in found if len(w) == length]
        flat = [x for w in chosen for x in w]
        hashes = wa.hash_values(pa.array(flat, pa.large_binary()))
        keys = wa.window_hashes(hashes, np.arange(0, len(flat), length), length)
        order = np.argsort(keys, kind="stable")
        matrix = np.array([[numbers.setdefault(x, len(numbers)) for x in w] for w in chosen], np.int64)
        by_size[length] = (keys[order], matrix[order], [sorted(found[chosen[i]]) for i in order.tolist()])
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        present[length] = bits
    return TestWindows(by_size, numbers, present)


def _hits(words: wa.Words, tests: TestWindows) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurring window, and the items found in each row."""
    hit = np.zeros(len(words.codes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    if not len(words.codes):
        return hit[:0].astype(bool), items
    hashes = words.hashes()
    own = np.array([tests.numbers.get(w, -1) for w in words.vocabulary.to_pylist()], np.int64)[words.codes]
    row_of = words.row_of
    for size, (keys, matrix, owners) in tests.by_size.items():
        starts = wa.windows(words, size)
        # a window with a word that no test has is no hit
        unknown = np.concatenate([[0], np.cumsum(own < 0)])
        starts = starts[unknown[starts + size] == unknown[starts]]
        if not len(starts):
            continue
        key = wa.window_hashes(hashes, starts, size)
        maybe = tests.present[size][(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        starts, key = starts[maybe], key[maybe]
        at = np.searchsorted(keys, key)
        while len(starts):
            # windows of equal hash stand next to each other
            open_ = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key)
            starts, key, at = starts[open_], key[open_], at[open_]
            same = (own[starts[:, None] + np.arange(size)] == matrix[at]).all(1)
            np.add.at(hit, starts[same], 1)
            np.add.at(hit, starts[same] + size, -1)
            for row, window in set(zip(row_of[starts[same]].tolist(), at[same].tolist())):
                items.setdefault(row, set()).update(owners[window])
            at = at + 1
    return np.cumsum(hit)[:-1] > 0, items


_FOUND = "n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def _scan(broadcast, keep: list[str], schema: pa.Schema):
    """Adds one part's hits to those of earlier parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = broadcast.value
        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                raw, offsets = wa.text_bytes(part.column("text"))
                words = wa.split_words(raw, offsets, wa.ALNUM, wa.LOWER)
                hit, items = _hits(words, tests)
                old_hits, old_items = part.column("hit_words").to_pylist(), part.column("items").to_pylist()
                hits, names, spans = [], [], []
                for row in range(part.num_rows):
                    a, b = int(words.rows[row]), int(words.rows[row + 1])
                    at = np.union1d(np.flatnonzero(hit[a:b]), np.array(old_hits[row], np.int64)).astype(np.int64)
                    hits.append(at)
                    names.append(sorted(items.get(row, set()) | set(old_items[row])))
                    spans.append(_spans(raw, offsets, words, row, at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).cast(schema.field(c).type) for c in keep),
                        pa.array(words.counts, pa.int64()),
                        pa.array(hits, pa.list_(pa.int32())),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array(spans, schema.field("spans").type),
                    ],
                    schema=schema,
                )

    return run


def _spans(raw: np.ndarray, offsets: np.ndarray, words: wa.Words, row: int, at: np.ndarray) -> list[dict]:
    """Code point ranges of the runs of hit words; what stands between two hit neighbours belongs to them."""
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > 1)
    first = at[np.concatenate([[0], breaks + 1])] + words.rows[row]
    last = at[np.concatenate([breaks, [len(at) - 1]])] + words.rows[row]
    text = raw[offsets[row] : offsets[row + 1]]
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [
        {"start": int(points[a]), "end": int(points[b])}
        for a, b in zip(words.begin[first] - offsets[row], words.end[last] - offsets[row])
    ]


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in parts of about so many bytes."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    stored = items if count == 1 else cut_lineage(items.withColumn("part", part))
    for i in range(count):
        rows = stored if count == 1 else stored.where(F.col("part") == i)
        yield [(r["item_id"] or "", r["text"]) for r in rows.select("item_id", "text").collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: tuple[str, ...] = (), part_bytes: int = PART_BYTES
) -> DataFrame:
    """The ``keep`` columns and ``n_words, hit_words, items, spans`` of every document.

    ``hit_words`` are the places of words inside an occurring window, ``items`` the items with such windows,
    sorted as strings, ``spans`` the code point ranges of the hit words. A null or empty text has no words.
    Repeated rows are each scanned. An item without words has no window; a null id counts as "".
    """
    spark = docs.sparkSession
    columns = list(dict.fromkeys([*keep, "text"]))
    found = docs.select(
        *columns,
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<int>").alias("hit_words"),
        F.array().cast("array<string>").alias("items"),
    )
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    out = f"{fields}, {_FOUND}"
    schema = to_arrow_schema(StructType.fromDDL(out))
    done = 0
    for items in _parts(benchmark, part_bytes):
        tests = spark.sparkContext.broadcast(test_windows(items, size))
        if done:
            found = cut_lineage(found)
        found = found.mapInArrow(_scan(tests, columns, schema), out)
        done += 1
    return found


def without_spans() -> F.Column:
    """The text without its ``spans``."""
    starts = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.char_length("text")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, size: int = WINDOW
) -> DataFrame:
    """Documents without test passages, with the columns of ``docs``.

    Hit spans are cut from a text. A document goes if more than ``max_share`` of its words are hit.
    """
    # a struct keeps the columns apart from the operator's own
    found = find_contamination(docs.select(F.struct(*docs.columns).alias("row"), "text"), benchmark, size, ("row",))
    share = F.size("hit_words") > max_share * F.col("n_words")
    cleaned = found.where(~share).select(F.col("row").withField("text", without_spans()).alias("row"))
    return cleaned.select("row.*")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_columns(find_contamination(docs, table(spark, sf_dir, "benchmark"), WINDOW, ("doc_id",)))


SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(list_slice(words, i, i + 9), ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item_words WHERE len(words) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
places AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
  FROM doc_words, (SELECT DISTINCT size FROM item_windows) WHERE len(words) >= size),
found AS (
  SELECT doc_id, item_id, i, p.size FROM places p JOIN item_windows w
  ON p.size = w.size AND array_to_string(list_slice(words, i, i + p.size - 1), ' ') = win),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
