"""Hard negatives from an inverted multi-index whose search certifies its results.

Two codebooks, one for each half of the vectors' components, divide the rows into cells of two codes. A row's score is its
inner product with the anchor, so a cell's scores are at most the sum of two half-scores: of the anchor's half with the
code, plus the length of that half times the code's radius (how far its rows lie from it). A multi-sequence heap takes the
cells of an anchor by descending bound. The search of an anchor ends when the next bound is below the score that every
one of its windows still wants; until then all rows of a cell are scored, so results are exact.

The index is a table of all rows, ordered by cell and cut into shards, so that a shard has few codes and a large cell many
shards. Anchors come in blocks of bounded size; every shard answers a block with its own heap, and the shards' short lists
are merged. Scores wanted at first come from the sample that the codebooks are made of: it is part of the rows, so the
k-th best in it is a bound for the k-th best of all. First the anchors' positives are found, then the negatives in the
windows of scores that the positives define.

A null id, label or vector, or a vector with a null or non-finite component, takes no part. Shorter vectors count as
filled up with zeros; an empty one is all zeros. Rows equal in id, label and vector count once; an id with several vectors
or labels stands for several rows, and no row of an anchor's id is its positive or negative. Equal scores are ordered by
ascending id. Of rows with one label and one vector only the first ids can be in a list, so that a shard scores no more of
them. An anchor without positives, or a positive without negatives in its window, has no rows. An empty table gives an empty
result. Other columns are not read. Scores are exact as long as they fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearwake.llm import word_arrays as wa
from clearwake.plans.registry import table
from clearwake.session import scratch_path

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows that the codebooks are made of and the first thresholds are taken from, chosen by a hash of the id.
SAMPLE_ROWS = 8192
CELL_ROWS = 32
MOST_CODES = 128
ITERATIONS = 8
#: Anchors of a block, rows of a shard and rows that are searched at once.
BLOCK_ANCHORS = 8192
SHARD_ROWS = 1 << 18
SEGMENT_ROWS = 1 << 15
#: Rows an anchor visits between two looks at its threshold, and pairs scored at once.
ROUND_ROWS = 1024
PAIRS = 1 << 20
_MERGED_TASKS = 512
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_EXACT = float(1 << 53)


# -- rows ----------------------------------------------------------------------------------------


def quantized(rows: DataFrame, label: Column, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part; components x become floor(256 * x)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"),
    )


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    sizes = np.asarray(pc.list_value_length(vectors)).astype(np.int64)
    values = np.asarray(pc.list_flatten(vectors)).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = values
    return out


# -- codebooks -----------------------------------------------------------------------------------


@dataclass
class Codebooks:
    """Centres of both halves; the first has ``split`` components."""

    split: int
    first: np.ndarray
    second: np.ndarray

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(vectors[:, : self.split], self.first), _nearest(vectors[:, self.split :], self.second)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    square = (centres**2).sum(1)
    for a in range(0, len(points), 4096):
        out[a : a + 4096] = (square - 2.0 * (points[a : a + 4096].astype(float) @ centres.T)).argmin(1)
    return out


def _centres(points: np.ndarray, count: int) -> np.ndarray:
    """Means of ``count`` clusters by Lloyd's iterations, started from evenly spread rows."""
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)].astype(float)
    for _ in range(ITERATIONS):
        code = _nearest(points, centres)
        sizes = np.bincount(code, minlength=count)
        total = np.zeros_like(centres)
        np.add.at(total, code, points)
        centres = np.where(sizes[:, None] > 0, total / np.maximum(1, sizes)[:, None], centres)
    return centres


def codebooks(sample: np.ndarray, rows: int) -> Codebooks:
    count = int(min(max(1, np.ceil(np.sqrt(rows / CELL_ROWS))), MOST_CODES, len(sample)))
    split = (sample.shape[1] + 1) // 2
    return Codebooks(split, _centres(sample[:, :split], count), _centres(sample[:, split:], count))


# -- search of one block of anchors ------------------------------------------------------------------


@dataclass
class Wanted:
    """Anchors, and windows of scores in which the first ``k`` rows of each are wanted."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: anchor of each window, in order, and its least and largest score
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    #: rows of the anchor's label, or of others
    same: bool
    #: k-th best score known so far
    threshold: np.ndarray


class Search:
    """The best rows of each window among those shown so far."""

    def __init__(self, wanted: Wanted, books: Codebooks) -> None:
        self.wanted, self.books = wanted, books
        self.threshold = wanted.threshold.copy()
        self.starts = np.searchsorted(wanted.anchor, np.arange(len(wanted.ids) + 1))
        self.points = wanted.vectors.astype(float)
        halves = self.points[:, : books.split], self.points[:, books.split :]
        self.half_scores = tuple(h @ c.T for h, c in zip(halves, (books.first, books.second)))
        self.half_lengths = tuple(np.sqrt((h**2).sum(1)) for h in halves)
        self.reach = float(np.abs(wanted.vectors).max(initial=0))
        #: window, score and id
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.last_id = np.full(len(wanted.anchor), _MOST)
        self.scored = 0
        self._limits()

    def _limits(self) -> None:
        """Scores between which an anchor still wants rows; the least is above the largest if it wants none."""
        count = len(self.wanted.ids)
        self.least, self.largest = np.full(count, _MOST), np.full(count, _LEAST)
        np.minimum.at(self.least, self.wanted.anchor, np.maximum(self.wanted.low, self.threshold))
        np.maximum.at(self.largest, self.wanted.anchor, self.wanted.high)

    def show(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        kept = first_of_copies(ids, labels, vectors, self.wanted.k + 1)
        ids, labels, vectors = ids[kept], labels[kept], vectors[kept]
        if not len(ids) or not len(self.wanted.anchor):
            return
        code = self.books.codes(vectors)
        order = np.lexsort((ids, code[1], code[0]))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        code = code[0][order], code[1][order]
        present, bounds = zip(*(self._half(h, code[h], vectors) for h in (0, 1)))
        cell = np.searchsorted(present[0], code[0]) * len(present[1]) + np.searchsorted(present[1], code[1])
        ends = np.searchsorted(cell, np.arange(len(present[0]) * len(present[1]) + 1))
        exact = vectors.shape[1] * float(np.abs(vectors).max(initial=0)) * self.reach < _EXACT
        points, anchors = (vectors.astype(float), self.points) if exact else (vectors, self.wanted.vectors)
        cells = {a: Cells(bounds[0][a], bounds[1][a], np.diff(ends)) for a in range(len(self.wanted.ids))}
        size = ROUND_ROWS
        while cells:
            visits: dict[int, list[int]] = {}
            for a in list(cells):
                chosen = cells[a].take(size, float(self.least[a]))
                for c in chosen:
                    visits.setdefault(c, []).append(a)
                if not chosen:
                    del cells[a]
            self._visit(visits, ends, ids, labels, points, anchors)
            size *= 2

    def _half(self, half: int, code: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half's codes that occur, and the half-score bound of each for all anchors."""
        split = self.books.split
        part = vectors[:, :split] if half == 0 else vectors[:, split:]
        centres = (self.books.first, self.books.second)[half]
        present, place = np.unique(code, return_inverse=True)
        radius = np.zeros(len(present))
        np.maximum.at(radius, place, np.sqrt(((part - centres[code]) ** 2).sum(1)))
        spread = self.half_lengths[half][:, None] * radius[None, :]
        scores = self.half_scores[half][:, present]
        # a little more than floats may lose
        return present, scores + spread + 1e-9 * (np.abs(scores) + spread) + 1e-6

    def _visit(self, visits: dict[int, list[int]], ends, ids, labels, points, anchors) -> None:
        found, count = [], 0
        for cell, who in visits.items():
            group = np.array(who)
            wide = max(1, PAIRS // len(group))
            for a in range(int(ends[cell]), int(ends[cell + 1]), wide):
                b = min(int(ends[cell + 1]), a + wide)
                score = np.rint(points[a:b] @ anchors[group].T).astype(np.int64)
                self.scored += score.size
                fits = (labels[a:b, None] == self.wanted.labels[group]) == self.wanted.same
                fits &= (score >= self.least[group]) & (score <= self.largest[group])
                fits &= ids[a:b, None] != self.wanted.ids[group]
                row, col = np.nonzero(fits)
                found.append((group[col], score[row, col], ids[a:b][row]))
                count += len(row)
                if count > PAIRS:
                    self._merge(found)
                    found, count = [], 0
        if found:
            self._merge(found)

    def _merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        who, score, ids = (np.concatenate(x) for x in zip(*found))
        sizes = self.starts[who + 1] - self.starts[who]
        pair = np.repeat(np.arange(len(who)), sizes)
        window = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[who], sizes)
        score, ids = score[pair], ids[pair]
        least = np.maximum(self.wanted.low[window], self.threshold[window])
        fits = (score >= least) & (score <= self.wanted.high[window])
        fits &= (score > self.threshold[window]) | (ids <= self.last_id[window])
        window, score, ids = (
            np.concatenate([old, new[fits]]) for old, new in zip(self.best, (window, score, ids))
        )
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        new = np.ones(len(window), bool)
        new[1:] = (window[1:] != window[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        window, score, ids = window[new], score[new], ids[new]
        position = np.arange(len(window)) - np.searchsorted(window, window)
        kept = position < self.wanted.k
        self.best = window[kept], score[kept], ids[kept]
        last = position == self.wanted.k - 1
        self.threshold[window[last]] = score[last]
        self.last_id[window[last]] = ids[last]
        self._limits()


class Cells:
    """Multi-sequence heap of one anchor: cells by descending sum of two half-score bounds."""

    def __init__(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> None:
        self.first, self.second, self.sizes = first, second, sizes
        self.order = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        self.heap = [(-float(first[self.order[0][0]] + second[self.order[1][0]]), 0, 0)]

    def take(self, rows: int, least: float) -> list[int]:
        """The next cells, of so many rows together; none when the next bound is below ``least``."""
        out, heap = [], self.heap
        (order1, order2), wide = self.order, len(self.second)
        while rows > 0 and heap and -heap[0][0] >= least:
            _, p, q = heapq.heappop(heap)
            i, j = int(order1[p]), int(order2[q])
            size = int(self.sizes[i * wide + j])
            if size:
                out.append(i * wide + j)
                rows -= size
            if q + 1 < wide:
                heapq.heappush(heap, (-float(self.first[i] + self.second[order2[q + 1]]), p, q + 1))
            if q == 0 and p + 1 < len(order1):
                heapq.heappush(heap, (-float(self.first[order1[p + 1]] + self.second[j]), p + 1, 0))
        return out


def first_of_copies(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without repeated ones, and of rows with one label and vector the ``most`` first ids."""
    factors = wa.mix(np.arange(1, vectors.shape[1] + 1, dtype=np.uint64)).view(np.int64)
    key = vectors @ factors
    order = np.lexsort((ids, labels, key))
    key, labels, ids, vectors = key[order], labels[order], ids[order], vectors[order]
    # equal keys are only a hint
    alike = np.zeros(len(order), bool)
    alike[1:] = (key[1:] == key[:-1]) & (labels[1:] == labels[:-1])
    alike[1:] &= (vectors[1:] == vectors[:-1]).all(1)
    repeated = alike.copy()
    repeated[1:] &= ids[1:] == ids[:-1]
    order, alike = order[~repeated], alike[~repeated]
    place = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(alike, 0, place))
    return order[place - begin < most]


# -- mining --------------------------------------------------------------------------------------


@dataclass
class Index:
    rows: DataFrame
    books: Codebooks
    width: int
    #: ids, labels and vectors of the sample
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]


def build(rows: DataFrame) -> Index | None:
    """The index of ``vec_id, label, vector``, written to the shared folder; none if there are no rows."""
    spark = rows.sparkSession
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not count:
        return None
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE_ROWS).toArrow().combine_chunks()
    sample = tuple(np.asarray(few[c]).astype(np.int64) for c in ("vec_id", "label"))
    vectors = matrix(_column(few, "vector"), width)
    books = codebooks(vectors, count)
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = shared.value.codes(matrix(batch.column("vector"), width))
            cell = pa.array(first * len(shared.value.second) + second, pa.int64())
            yield pa.RecordBatch.from_arrays([cell, *batch.columns], names=["cell", *batch.schema.names])

    shards = max(2 * spark.sparkContext.defaultParallelism, -(-count // SHARD_ROWS))
    path = scratch_path(spark, "multi-index")
    celled = rows.mapInArrow(assign, "cell bigint, vec_id bigint, label bigint, vector array<bigint>")
    # ids divide a large cell
    celled.repartitionByRange(shards, "cell", "vec_id").write.parquet(path)
    return Index(spark.read.parquet(path), books, width, (*sample, vectors))


def _column(arrow: pa.Table, name: str) -> pa.Array:
    column = arrow[name]
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _run(index: Index, wanted: Wanted) -> DataFrame:
    """``window, score, vec_id``: the first rows of each window, merged over all shards."""
    spark = index.rows.sparkSession
    # on the sample alone, for thresholds
    trial = Search(wanted, index.books)
    for a in range(0, len(index.sample[0]), SEGMENT_ROWS):
        trial.show(*(x[a : a + SEGMENT_ROWS] for x in index.sample))
    wanted.threshold = trial.threshold
    shared = spark.sparkContext.broadcast((wanted, index.books))
    width = index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value)
        for ids, labels, vectors in _segments(batches, width):
            search.show(ids, labels, vectors)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search.best], names=["window", "score", "vec_id"])

    found = index.rows.select("vec_id", "label", "vector").mapInArrow(run, "window bigint, score bigint, vec_id bigint")
    some = found.withColumn("task", F.floor(F.spark_partition_id() / _MERGED_TASKS))
    return _first(_first(some, wanted.k, "window", "task").drop("rank"), wanted.k, "window")


def _first(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    """The first ``k`` of each group; a row that two shards gave (of a repeated one) counts once."""
    once = rows.dropDuplicates([*groups, "score", "vec_id"])
    window = Window.partitionBy(*groups).orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, count = [], 0
    for batch in batches:
        held.append((*(np.asarray(batch.column(c)) for c in ("vec_id", "label")), matrix(batch.column("vector"), width)))
        count += batch.num_rows
        if count >= SEGMENT_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _block(index: Index, chosen: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    """The result for one block of anchors."""
    spark = chosen.sparkSession
    arrow = chosen.select("vec_id", "label", "vector").toArrow().combine_chunks()
    if not arrow.num_rows:
        return None
    ids, labels = (np.asarray(arrow[c]).astype(np.int64) for c in ("vec_id", "label"))
    vectors = matrix(_column(arrow, "vector"), index.width)
    kept = first_of_copies(ids, labels, vectors, len(ids))
    ids, labels, vectors = ids[kept], labels[kept], vectors[kept]
    count = len(ids)
    everything = Wanted(
        ids, labels, vectors, np.arange(count), np.full(count, _LEAST), np.full(count, _MOST), positives, True,
        np.full(count, _LEAST),
    )
    # at most BLOCK_ANCHORS times positives
    pairs = _run(index, everything).orderBy("window", "rank").toArrow()
    anchor, score, positive = (np.asarray(pairs[c]).astype(np.int64) for c in ("window", "score", "vec_id"))
    if not len(anchor):
        return None
    hard = Wanted(
        ids, labels, vectors, anchor, -((-low * score) // 100), (high * score) // 100, negatives, False,
        np.full(len(anchor), _LEAST),
    )
    names = spark.createDataFrame(
        pa.table({"window": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score})
    )
    return (
        _run(index, hard)
        .join(F.broadcast(names), "window")
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """For each of the first ``positives`` rows of an anchor's label, the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's.

    ``rows`` has ``vec_id, label`` and ``vector`` (whole numbers); ``anchors`` tells which rows are anchors.
    """
    spark = rows.sparkSession
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], RESULT)
    chosen = index.rows.where(anchors)
    blocks = max(1, -(-chosen.count() // block_anchors))
    if blocks == 1:
        found = _block(index, chosen, positives, negatives, low, high)
        return spark.createDataFrame([], RESULT) if found is None else found
    path = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for i in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        found = _block(index, part, positives, negatives, low, high)
        if found is not None:
            found.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantized(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM scores WHERE same)
  WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS place
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 10
"""
