import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clearwake.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, "The cat sat on the mat, the cat."),
    (2, "A dog; a CAT and a Über-dog"),
    (3, None),
    (4, ""),
    (5, "... !!! ,,,"),
    (6, "cat " * 3000 + "dog"),
    (7, "The cat sat on the mat, the cat."),
    (7, "The cat sat on the mat, the cat."),
    (None, "the mat"),
    (9, "über alles 7 7 7 zwölf"),
    (10, " ".join(f"w{i}" for i in range(5000))),
]
ITEMS = [(1, "cat mat"), (2, "Cat? CAT dog"), (3, "nothing-here"), (4, None), (5, ""), (6, "w17 w4999 the"), (None, "über 7"), (1, "sat")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, k=10):
    texts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if t is not None]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(TERM.findall(lower(text or "")))
    rows = []
    for item, words in terms.items():
        scored = []
        for doc, c in texts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
                for w in words
                if c[w]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            rows.append((item, rank, doc, -score))
    return rows


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, item_id string"),
        spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, doc_id int"),
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("k, part_items", [(10, 512), (2, 1)])
def test_equals_brute_force(spark, k, part_items):
    docs, items = frames(spark, DOCS, ITEMS)
    assert got(ls.search(docs.repartition(4), items, k, part_items=part_items)) == sorted(brute(DOCS, ITEMS, k), key=str)


def test_given_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(ls.query(spark, sf_dir)) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert ls.search(docs.limit(0), items).collect() == []
    assert ls.search(docs, items.limit(0)).collect() == []
    assert ls.search(docs, items.where("item_id = 5")).collect() == []


def test_sketches_bound_scores(monkeypatch):
    """Also where places of a sketch are shared by many terms."""
    monkeypatch.setattr(ls, "COORDINATES", 8)
    random = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in random.zipf(1.3, random.integers(1, 200)) if x < 500) for _ in range(300)]
    items = [(i, " ".join(f"t{x}" for x in random.integers(1, 60, 5))) for i in range(20)]
    docs = list(enumerate(texts))
    queries = ls.queries_of(items)
    words = ls.terms_of(pa.array(texts))
    row, code, tf = ls.frequencies(words)
    places = ls._places(words.vocabulary, queries.terms)
    holding = np.bincount(places[code][places[code] >= 0], minlength=len(queries.terms))
    stats = ls.Statistics(int(np.count_nonzero(words.counts)), len(words.codes), holding)
    searcher = ls.Searcher(queries, stats, 3)
    searcher.show(np.arange(len(texts)), pa.array(texts))
    item, score, ids = searcher.best
    position = np.arange(len(item)) - np.searchsorted(item, item) + 1
    assert sorted(zip(item.tolist(), position.tolist(), ids.tolist(), score.tolist())) == sorted(brute(docs, items, 3))
    assert searcher.rescored < searcher.bounded
