"""Ranked text search over the document table: BM25 from stored term frequencies.

A term index is a table of postings (``term, id, tf, length``) ordered by term, written once per state of the documents. A
search reads the postings of the queries' terms only and brings those of a document together once; a task scores all queries
on its documents and keeps the best ``k`` of each before any scores meet. Scores are those of the common search servers:
``idf * tf / (tf + K1 * (1 - B + B * length / mean length))`` with ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearwake.functions.text import word_tokens
from clearwake.session import broadcast_if_small, cut_lineage

# The usual parameters of BM25.
K1 = 1.2
B = 0.75
#: Scores are compared, and given, with so many digits, as sums of floats depend on their order.
DIGITS = 9
#: Query terms that are sent to all tasks; more are searched for in parts.
MOST_TERMS = 10_000
#: Postings that a partition holds, that are scored together, and that are multiplied at once; queries in one dense block.
SHARE_POSTINGS = 2_000_000
ROWS_OF_SHARE = 500_000
POSTINGS_AT_ONCE = 8_192
QUERY_BLOCK = 256


class TermIndex(NamedTuple):
    postings: DataFrame
    #: one row: ``documents`` with a term, and the sum of their ``length``
    totals: DataFrame


def term_index(documents: DataFrame, key: str = "id", field: str = "content", only: DataFrame | None = None) -> TermIndex:
    """Postings of lower-cased words. A row without words, or with a null text, is no document; ``key`` identifies a row.

    With ``only`` (queries with a ``text``) postings of other words than theirs are left out before words are counted and
    exchanged; scores of these queries are the same.
    """
    words = documents.select(F.col(key).alias("id"), word_tokens(field).alias("_w")).where(F.size("_w") > 0)
    rows = words.select("id", F.size("_w").alias("length"), F.explode("_w").alias("term"))
    if only is not None:
        wanted = only.select(F.explode(word_tokens("text")).alias("term")).distinct()
        rows = rows.join(broadcast_if_small(wanted, MOST_TERMS), "term", "left_semi")
    postings = (
        rows.groupBy("term", "id", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    totals = words.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("_w")), F.lit(0)).alias("length"))
    return TermIndex(postings.select("term", "id", "tf", "length"), totals)


def write_term_index(index: TermIndex, path: str) -> None:
    """Store the index. Postings are ordered by term, so a search skips the files and pages without its terms."""
    index.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    index.totals.coalesce(1).write.parquet(f"{path}/totals")


def read_term_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))


def bm25(index: TermIndex, queries: DataFrame, k: int = 10, most_queries: int = MOST_TERMS) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` best documents of every query (``query_id, text``).

    A query's terms count once. Equal scores are ordered by id; a query whose terms no document holds has no rows. Postings
    meet once per document, not once per query. Each part of the queries (about ``most_queries`` terms) reads its postings anew.
    """
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(word_tokens("text"))).alias("term"))
    # a query that is given twice counts twice
    asked = cut_lineage(asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_m")))
    parts = max(1, -(-asked.count() // most_queries))
    of = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    scored = reduce(DataFrame.unionByName, [_part_scores(index, asked.where(of == i), k) for i in range(parts)])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _part_scores(index: TermIndex, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: the ``k`` best of the queries in each of some shares of the documents, for queries that are
    small enough to be sent to all tasks."""
    held = index.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    # totals are one row
    count = index.totals.select(F.col("documents").alias("_n"), (F.col("length") / F.col("documents")).alias("_mean"))
    shared = F.col("_df") * F.col("_m")
    idf = F.col("_m") * F.log(1.0 + (F.col("_n") - shared + 0.5) / (shared + 0.5))
    weights = asked.join(df, "term").crossJoin(F.broadcast(count)).select("query_id", "term", "_df", "_mean", idf.alias("_w")).collect()
    names = sorted({r["query_id"] for r in weights})
    terms = {r["term"]: r["_df"] for r in weights}
    numbers = {t: i for i, t in enumerate(sorted(terms))}
    places = {q: i for i, q in enumerate(names)}
    table = [(numbers[r["term"]], places[r["query_id"]], r["_w"]) for r in weights]
    mean = weights[0]["_mean"] if weights else 1.0
    spark, kind, name = asked.sparkSession, index.postings.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    listed = spark.createDataFrame(list(numbers.items()), "term string, _t int")
    part = F.col("tf") / (F.col("tf") + K1 * (1.0 - B + B * F.col("length") / F.lit(mean)))
    shares = max(1, -(-sum(terms.values()) // SHARE_POSTINGS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = index.postings.join(F.broadcast(listed), "term").select("id", "_t", "tf", "length").repartition(shares, "id")
    # equal texts add up in the same order
    rows = rows.sortWithinPartitions("id", "_t", "length").select("id", "_t", part.alias("_part"))
    best = rows.mapInArrow(_best_of_share(table, len(names), k), f"_q int, id {kind}, _score double")
    named = spark.createDataFrame(list(enumerate(names)), f"_q int, query_id {name}")
    return best.join(F.broadcast(named), "_q").select("query_id", "id", F.round("_score", DIGITS).alias("score"))


def _best_of_share(table: list[tuple[int, int, float]], queries: int, k: int) -> Callable:
    """The ``k`` best documents of each query among every few thousand, from ``id, _t, _part`` rows ordered by id."""
    blocks = []
    for start in range(0, queries, QUERY_BLOCK):
        own = [(t, q - start, w) for t, q, w in table if start <= q < start + QUERY_BLOCK]
        used = sorted({t for t, _, _ in own})
        matrix = np.zeros((len(used), min(QUERY_BLOCK, queries - start)))
        where = {t: i for i, t in enumerate(used)}
        for t, q, w in own:
            matrix[where[t], q] = w
        blocks.append((start, np.array(used), matrix))

    def scored(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["id"].combine_chunks()
        terms, parts = rows["_t"].to_numpy(), rows["_part"].to_numpy()
        first = np.concatenate([[0], _changes(ids)])
        document = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        for start, used, matrix in blocks:
            place = np.minimum(np.searchsorted(used, terms), len(used) - 1)
            known = np.flatnonzero(used[place] == terms)
            score, held = np.zeros((len(first), matrix.shape[1])), np.zeros((len(first), matrix.shape[1]), dtype=bool)
            for at in range(0, len(known), POSTINGS_AT_ONCE):
                some = known[at : at + POSTINGS_AT_ONCE]
                weight = matrix[place[some]]
                runs = np.concatenate([[0], np.flatnonzero(np.diff(document[some])) + 1])
                score[document[some[runs]]] += np.add.reduceat(weight * parts[some, None], runs)
                held[document[some[runs]]] |= np.logical_or.reduceat(weight != 0, runs)
            # documents are in the order of their ids, and equal scores stay so
            ranked = np.where(held, -np.round(score, DIGITS), np.inf)
            if len(first) > k:
                limit = np.partition(ranked, k - 1, axis=0)[k - 1]
            else:
                limit = np.full(matrix.shape[1], np.inf)
            for q in range(matrix.shape[1]):
                chosen = np.flatnonzero((ranked[:, q] <= limit[q]) & held[:, q])
                chosen = chosen[np.argsort(ranked[chosen, q], kind="stable")[:k]]
                if len(chosen):
                    columns = [pa.array(np.full(len(chosen), start + q, dtype="int32")), ids.take(pa.array(first[chosen])), pa.array(score[chosen, q])]
                    yield pa.RecordBatch.from_arrays(columns, ["_q", "id", "_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= ROWS_OF_SHARE:
                rows = pa.Table.from_batches(waiting)
                changes = _changes(rows["id"].combine_chunks())
                # the last document may go on in the next batch
                if len(changes):
                    yield from scored(rows.slice(0, changes[-1]))
                    rows = rows.slice(changes[-1])
                waiting, size = rows.to_batches(), rows.num_rows
        if size:
            yield from scored(pa.Table.from_batches(waiting))

    return run


def _changes(ids: pa.Array) -> np.ndarray:
    """Where another id begins, but for the first."""
    after, before = ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))
    same = pc.or_(pc.fill_null(pc.equal(after, before), False), pc.and_(pc.is_null(after), pc.is_null(before)))
    return np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1
