import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwake.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """``rows`` are distinct (id, label, whole-number vector)."""
    wide = max((len(v) for _, _, v in rows), default=0)
    rows = sorted({(i, label, (*v, *[0] * (wide - len(v)))) for i, label, v in rows})
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted({(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a})
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(s, i) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, **kw):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label long, vector array<long>, anchor_id int")
    return sorted(tuple(r) for r in hn.mine(df.repartition(3), is_anchor, **kw).collect())


def some_rows(count, seed=1, wide=6, groups=12):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 60, (groups, wide))
    return [
        (i, int(random.integers(0, 3)), [int(x) for x in np.floor(centres[random.integers(groups)] + random.normal(0, 9, wide))])
        for i in range(count)
    ]


@pytest.mark.parametrize("block", [8192, 7])
def test_equals_brute_force(spark, block):
    rows = some_rows(700)
    # many copies, ties, repeated rows, and an id with two vectors
    rows += [(1000 + i, i % 2, [50, 40, -30, 20, 10, 0]) for i in range(80)]
    rows += rows[:20] + [(5, 2, [1, 2, 3, 4, 5, 6]), (2000, 1, []), (2001, 1, [7]), (2002, 0, [0, 0, 0, 0, 0, 0])]
    assert mined(spark, rows, F.col("vec_id") % 20 == 0, block_anchors=block) == brute(rows, lambda i: i % 20 == 0)


def test_large_components(spark):
    rows = [(i, i % 2, [(1 << 29) + i, 3 - i, i * i]) for i in range(40)]
    assert mined(spark, rows, F.col("vec_id") < 4) == brute(rows, lambda i: i < 4)


def test_other_numbers(spark):
    rows = some_rows(200, 2)
    want = brute(rows, lambda i: i < 9, 2, 3, 10, 100)
    assert mined(spark, rows, F.col("vec_id") < 9, positives=2, negatives=3, low=10, high=100) == want and want


def test_rows_that_take_no_part(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.7, 0.2]), (3, None, [1.0, 1.0]), (4, 2, None),
        (5, 2, [0.5, None]), (6, 2, [0.5, NAN]), (8, 2, [INF, 0.1]), (None, 2, [0.6, 0.1]), (9, 2, [-INF, 0.1]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    kept = hn.quantized(df, F.col("label"))
    assert [r["vec_id"] for r in kept.orderBy("vec_id").collect()] == [0, 1, 2]
    floors = [math.floor(256 * float(np.float32(x))) for x in (0.7, 0.2)]
    assert kept.where("vec_id = 2").first()["vector"] == floors
    found = hn.mine(kept, F.col("vec_id") == 0).collect()
    assert [(r["positive_id"], r["negative_id"]) for r in found] == [(1, 2)]


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, 1, [1]), (2, 2, [2])], "vec_id long, label long, vector array<long>")
    assert hn.mine(df.limit(0), F.col("vec_id") == 1).collect() == []
    assert hn.mine(df, F.col("vec_id") == 7).collect() == []
    assert hn.mine(df, F.col("vec_id") == 1).collect() == []


def test_certified_search_leaves_cells_out():
    """On rows in groups most cells are not visited, and the result is that of all rows."""
    rows = some_rows(4000, 5, 16, 40)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    vectors = np.array([r[2] for r in rows])
    books = hn.codebooks(vectors[:1000], len(rows))
    anchors = np.arange(0, 4000, 100)
    count = len(anchors)
    least, most = np.full(count, hn._LEAST), np.full(count, hn._MOST)
    wanted = hn.Wanted(ids[anchors], labels[anchors], vectors[anchors], np.arange(count), least, most, 5, True, least)
    search = hn.Search(wanted, books)
    for a in range(0, 4000, 1000):
        search.show(ids[a : a + 1000], labels[a : a + 1000], vectors[a : a + 1000])
    scores = vectors[anchors] @ vectors.T
    for w, a in enumerate(anchors):
        others = [(-int(scores[w, i]), i) for i in range(4000) if i != a and labels[i] == labels[a]]
        mine = search.best[0] == w
        assert list(zip((-search.best[1][mine]).tolist(), search.best[2][mine].tolist())) == sorted(others)[:5]
    assert search.scored < 0.5 * scores.size


def test_heap_gives_cells_by_bound():
    random = np.random.default_rng(4)
    first, second = random.normal(size=7), random.normal(size=5)
    sizes = random.integers(0, 4, 35)
    heap = hn.Cells(first, second, sizes)
    out = []
    while chosen := heap.take(3, -100.0):
        out += chosen
    bound = (first[:, None] + second[None, :]).ravel()
    assert out == [c for c in np.argsort(-bound, kind="stable").tolist() if sizes[c]]
    assert hn.Cells(first, second, sizes).take(3, 100.0) == []
