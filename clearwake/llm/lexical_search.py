"""Ranked lexical search: hashed max-sketches bound the scores, the best bounds are rescored exactly.

A term's impact in a document depends on how often it occurs there and on the document's length. A document's sketch holds,
for each of ``COORDINATES`` hashed places, the largest impact of the terms that fall there. The weighted sum over the
places of a query's terms is at least the document's score, so one product of the sketches of a block of documents with a
batch of queries bounds all their scores. Documents are then rescored exactly by descending bound, until the bound falls
below the score of the k-th best document so far. Every document is bounded and the results are exact.

Queries come in parts of bounded size; each part reads the documents twice: for the counts that weights and
lengths need, and to search. Documents stay where they are; a task gives at most k rows for each query.

Terms are runs of ASCII letters, digits and everything beyond ASCII in the whole text, with A-Z lower-cased. A null or empty
text, or one without terms, is no document and matches nothing. Rows of one item id are one item with the terms of all
its texts; a null id is an id. An item without terms has no rows. Repeated documents are ranked one by one. Equal scores are
ordered by ascending document id, null last. Empty tables give an empty result. Columns other than the ids and texts are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table
from clearwake.session import cut_lineage

TOP = 10
#: Places of a sketch, a power of two.
COORDINATES = 8192
#: Documents whose sketches are held at once, and candidates of a query that are rescored at once.
BLOCK_ROWS = 256
ROUND = 8
#: About so many bytes of text and items make a part of the queries.
PART_BYTES = 256 << 10
PART_ITEMS = 512
#: Sums of floats above 2^53 may be rounded down by less than this.
_SLACK = 1.0 + 1e-11
#: Tasks whose results are merged first.
_MERGED_TASKS = 512
_NO_ID = np.iinfo(np.int64).max


def terms_of(texts: pa.Array) -> wa.Words:
    raw, offsets = wa.text_bytes(texts)
    return wa.split_words(raw, offsets, wa.ALNUM, wa.LOWER)


@dataclass
class Queries:
    """Terms of some items. ``item_terms[i]`` are places in ``terms``."""

    ids: list
    terms: pa.Array
    item_terms: list[np.ndarray]


def queries_of(items: Sequence[tuple[object, str | None]]) -> Queries:
    words = terms_of(pa.array([text for _, text in items], pa.large_string()))
    by_id: dict[object, set[int]] = {}
    for i, (item, _) in enumerate(items):
        by_id.setdefault(item, set()).update(words.codes[words.rows[i] : words.rows[i + 1]].tolist())
    return Queries(list(by_id), words.vocabulary, [np.array(sorted(codes), np.int64) for codes in by_id.values()])


def frequencies(words: wa.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of occurrences of every different term of a row, in order of both."""
    wide = max(1, len(words.vocabulary))
    keys, counts = np.unique(words.row_of * wide + words.codes, return_counts=True)
    return keys // wide, keys % wide, counts


# -- statistics ----------------------------------------------------------------------------------


@dataclass
class Statistics:
    documents: int
    terms: int
    #: documents that hold each query term
    holding: np.ndarray


def statistics(docs: DataFrame, terms: pa.Array) -> Statistics:
    """Counts over all documents. A task sends one row for each query term it saw; there are as many sums as terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted) + 2, np.int64)
        for batch in batches:
            for first, last in wa.slices(batch.column("text")):
                words = terms_of(batch.column("text").slice(first, last - first))
                _, codes, _ = frequencies(words)
                known = _places(words.vocabulary, wanted)[codes]
                total[:-2] += np.bincount(known[known >= 0], minlength=len(wanted))
                total[-2] += np.count_nonzero(words.counts)
                total[-1] += len(words.codes)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["place", "n"])

    sums = np.zeros(len(terms) + 2, np.int64)
    counted = docs.select("text").mapInArrow(count, "place bigint, n bigint")
    for row in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[row["place"]] = row["n"]
    return Statistics(int(sums[-2]), int(sums[-1]), sums[:-2])


def _places(vocabulary: pa.Array, wanted: pa.Array) -> np.ndarray:
    """Place of each vocabulary word among the wanted ones, -1 for others."""
    return np.asarray(pc.fill_null(pc.index_in(vocabulary, value_set=wanted), -1)).astype(np.int64)


def weights(stats: Statistics) -> np.ndarray:
    """Weight of each query term; 0 for one that no document holds."""
    return np.array(
        [
            math.floor(1000 * math.log((2 * stats.documents + 2) / (2 * int(df) + 1))) if df else 0
            for df in stats.holding
        ],
        np.int64,
    )


def lengths(counts: np.ndarray, stats: Statistics) -> np.ndarray:
    """How long documents of so many terms are next to the mean, in hundredths, damped. Products may exceed 64 bits."""
    rule = {n: 100 - 90 + (90 * n * stats.documents) // max(1, stats.terms) for n in np.unique(counts).tolist()}
    return np.array([rule[n] for n in counts.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


# -- search --------------------------------------------------------------------------------------


class Searcher:
    """Best documents of each item among those shown so far."""

    def __init__(self, queries: Queries, stats: Statistics, k: int = TOP) -> None:
        self.queries, self.stats, self.k = queries, stats, k
        self.weight = weights(stats)
        # a place that no query term falls on bounds nothing
        place = (wa.hash_values(queries.terms) & np.uint64(COORDINATES - 1)).astype(np.int64)
        used, column = np.unique(place, return_inverse=True)
        self.columns = np.full(COORDINATES, -1, np.int64)
        self.columns[used] = np.arange(len(used))
        count = len(queries.ids)
        self.query_matrix = np.zeros((len(used), count))
        for i, codes in enumerate(queries.item_terms):
            np.add.at(self.query_matrix[:, i], column[codes], self.weight[codes])
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in queries.item_terms], dtype=np.int64)])
        self.flat = np.concatenate([*queries.item_terms, np.zeros(0, np.int64)]).astype(np.int64)
        #: item, score and document of the best so far; the k-th score of each item, 0 as long as there are fewer
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.threshold = np.zeros(count, np.int64)
        self.bounded = self.rescored = 0

    def show(self, ids: np.ndarray, texts: pa.Array) -> None:
        words = terms_of(texts)
        if not len(words.codes):
            return
        row, code, tf = frequencies(words)
        impact = impacts(tf, lengths(words.counts, self.stats)[row])
        place = (wa.hash_values(words.vocabulary) & np.uint64(COORDINATES - 1)).astype(np.int64)
        column = self.columns[place[code]]
        known = _places(words.vocabulary, self.queries.terms)[code]
        for first in range(0, len(ids), BLOCK_ROWS):
            last = min(len(ids), first + BLOCK_ROWS)
            a, b = np.searchsorted(row, [first, last])
            self._block(ids[first:last], row[a:b] - first, column[a:b], known[a:b], impact[a:b])

    def bounds(self, count: int, row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of ``count`` documents for all items."""
        sketch = np.zeros((count, len(self.query_matrix)))
        inside = column >= 0
        np.maximum.at(sketch, (row[inside], column[inside]), impact[inside].astype(float))
        return sketch @ self.query_matrix

    def _block(self, ids: np.ndarray, row: np.ndarray, column: np.ndarray, known: np.ndarray, impact: np.ndarray) -> None:
        bound = self.bounds(len(ids), row, column, impact) * _SLACK
        self.bounded += bound.size
        doc, item = np.nonzero((bound > 0) & (bound >= self.threshold))
        if not len(doc):
            return
        limit = bound[doc, item]
        order = np.lexsort((-limit, item))
        doc, item, limit = doc[order], item[order], limit[order]
        position = np.arange(len(item)) - np.searchsorted(item, item)
        exact = known >= 0
        wide = len(self.queries.terms)
        keys, values = row[exact] * wide + known[exact], impact[exact]
        by_key = np.argsort(keys)
        keys, values = keys[by_key], values[by_key]
        for start in range(0, int(position.max()) + 1, ROUND):
            now = (position >= start) & (position < start + ROUND) & (limit >= self.threshold[item])
            if not now.any():
                # limits fall with the position and thresholds only rise
                break
            score = self._scores(doc[now], item[now], keys, values)
            self.rescored += len(score)
            self._merge(item[now], score, ids[doc[now]])

    def _scores(self, doc: np.ndarray, item: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Exact scores of pairs, from the impacts of query terms in the block (``keys`` in order)."""
        sizes = self.starts[item + 1] - self.starts[item]
        pair = np.repeat(np.arange(len(item)), sizes)
        term = self.flat[np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[item], sizes)]
        key = doc[pair] * len(self.queries.terms) + term
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        total = np.zeros(len(item), np.int64)
        np.add.at(total, pair[found], self.weight[term[found]] * values[at[found]])
        return total

    def _merge(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        above = score > 0
        item, score, ids = (np.concatenate([old, new[above]]) for old, new in zip(self.best, (item, score, ids)))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        position = np.arange(len(item)) - np.searchsorted(item, item)
        kept = position < self.k
        self.best = item[kept], score[kept], ids[kept]
        last = position == self.k - 1
        self.threshold[item[last]] = score[last]


def _search(docs: DataFrame, queries: Queries, stats: Statistics, item_type: str, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best documents of every task."""
    out = f"item_id {item_type}, doc_id bigint, score bigint"
    schema = to_arrow_schema(StructType.fromDDL(out))
    shared = docs.sparkSession.sparkContext.broadcast((queries, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, k)
        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column("doc_id"), _NO_ID)).astype(np.int64)
            for first, last in wa.slices(batch.column("text")):
                searcher.show(ids[first:last], batch.column("text").slice(first, last - first))
        item, score, found = searcher.best
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([searcher.queries.ids[i] for i in item.tolist()], schema.field("item_id").type),
                pa.array(found, pa.int64(), mask=found == _NO_ID),
                pa.array(score, pa.int64()),
            ],
            schema=schema,
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def _parts(items: DataFrame, part_bytes: int, part_items: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items, in parts of about so many bytes and rows; rows of one id are in one part."""
    total, rows = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    count = max(1, -(-total // part_bytes), -(-rows // part_items))
    part = F.pmod(F.xxhash64("item_id"), F.lit(count))
    stored = items if count == 1 else cut_lineage(items.withColumn("part", part))
    for i in range(count):
        chosen = stored if count == 1 else stored.where(F.col("part") == i)
        yield [(r["item_id"], r["text"]) for r in chosen.select("item_id", "text").collect()]


def _first(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, part_bytes: int = PART_BYTES, part_items: int = PART_ITEMS
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents (``doc_id, text``) of every item (``item_id, text``).

    Only scores above 0 count.
    """
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType.simpleString()
    lists = []
    for part in _parts(items.select("item_id", "text").where(F.col("text").isNotNull()), part_bytes, part_items):
        queries = queries_of(part)
        if len(queries.terms):
            lists.append(_search(docs, queries, statistics(docs, queries.terms), item_type, k))
    none = spark.createDataFrame([], f"item_id {item_type}, doc_id bigint, score bigint")
    found = reduce(DataFrame.unionByName, lists) if lists else none
    # the tasks' lists are merged in two steps, so none meets the lists of all tasks
    some = found.withColumn("task", F.floor(F.spark_partition_id() / _MERGED_TASKS))
    merged = _first(_first(some, k, "item_id", "task").drop("rank"), k, "item_id")
    return merged.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
lengths AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // words AS m FROM sizes, total),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
