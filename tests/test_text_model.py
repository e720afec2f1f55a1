"""Terms counted from Arrow lists, and the text model's fit in few passes."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearwake.operators import learn, softmax, term_arrays
from clearwake.operators.learn import load_text_model, term_rows, top_terms, top_text_terms, train_text
from clearwake.session import scratch_path

CASES = "id long, text string, entities array<struct<text:string,type:string>>, expected_label string"
TEXTS = ["red big red", "big", None, "red big", "", "x y", "big red big red big", "é_1 Éa éa", "red"]


def words_of(text):
    return [w for w in (text or "").lower().split() if len(w) > 1]


@pytest.mark.parametrize("at_once", [1, 3, 1 << 17])
def test_terms_of_slices(monkeypatch, at_once):
    """Words and bigrams are the same whatever is worked on at once; none spans two rows."""
    monkeypatch.setattr(term_arrays, "SLICE_WORDS", at_once)
    monkeypatch.setattr(term_arrays, "PAIRS_SORTED", at_once)
    monkeypatch.setattr(term_arrays, "SLICES_ADDED", 2)
    lists = [words_of(t) for t in TEXTS]
    want = Counter(w for ws in lists for w in ws) + Counter(f"{a} {b}" for ws in lists for a, b in zip(ws, ws[1:]))
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["words"]) for part in (lists[:4], [], lists[4:])]
    found = Counter()
    for batch in term_arrays.term_counts(np.ones(64, bool))(iter(batches)):
        for term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[term] += n
    assert found == want
    places = list(term_arrays.place_counts(64)(iter(batches)))
    assert sum(sum(b.column(1).to_pylist()) for b in places) == sum(want.values())
    terms = sorted(want)[1:]
    got = term_arrays.TermCounter(terms).lists(pa.array(lists, pa.list_(pa.string()))).to_pylist()
    for ws, entries in zip(lists, got):
        bag = Counter(ws) + Counter(f"{a} {b}" for a, b in zip(ws, ws[1:]))
        assert [(terms[e["i"]], e["tf"]) for e in entries] == sorted((t, n) for t, n in bag.items() if t in terms)


@pytest.mark.parametrize("places, first", [(1 << 18, 4), (16, 1)])
def test_top_terms_of_texts(spark, monkeypatch, places, first):
    monkeypatch.setattr(learn, "TERM_PLACES", places)
    monkeypatch.setattr(learn, "PLACES_PER_TERM", first)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randint(0, 30))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for size in (5, 40):
        want = [r["term"] for r in top_terms(term_rows(frame, "id", "text"), size).collect()]
        assert [r["term"] for r in top_text_terms(frame, "text", size).collect()] == want


def mixed(spark, count):
    """Rows whose label is often, but not always, that of a word; some without words, two with one key."""
    rng, rows = random.Random(2), []
    for i in range(count):
        label = rng.choice(["A", "A", "A", "B", "C"])
        words = rng.choices([f"w{j}" for j in range(80)], [1 / (1 + j) for j in range(80)], k=rng.randint(0, 12))
        named = label if rng.random() < 0.8 else rng.choice("ABC")
        rows.append((max(i, 1), " ".join(words + [f"is{named.lower()}"] * rng.randint(0, 2)), [], label))
    return spark.createDataFrame(rows, CASES)


def test_fit_in_passes(spark, monkeypatch):
    """The minimum that Spark's solver goes to, in few passes, however many rows there are and whatever is summed by tasks."""
    passes, sums = [], softmax.total_sums
    monkeypatch.setattr(softmax, "total_sums", lambda *a: passes.append(a) or sums(*a))
    frame = mixed(spark, 600)
    by_spark = train_text(frame, size=150)
    assert not passes
    monkeypatch.setattr(learn, "FEW_ENTRIES", 0)
    monkeypatch.setattr(softmax, "MOMENT_TERMS", 100)
    model = train_text(frame, size=150)
    collected = sums(*passes[-1])
    with monkeypatch.context() as patch:
        patch.setattr(softmax, "COLLECTED_BYTES", 0)
        assert np.allclose(sums(*passes[-1]), collected)
    assert model.labels == by_spark.labels == ["A", "B", "C"] and 0 < len(passes) < 60
    assert np.abs(model.classifier.coefficientMatrix.toArray() - by_spark.classifier.coefficientMatrix.toArray()).max() < 0.02
    one, two = ({r["text"]: (r["ml_label"], r["confidence"]) for r in m.transform(frame).collect()} for m in (by_spark, model))
    assert all(one[t][0] == two[t][0] and abs(one[t][1] - two[t][1]) <= 1 for t in one if one[t][1] > 51)
    path = scratch_path(spark, "passes")
    model.save(path)
    again = load_text_model(spark, path).transform(frame).select("id", "text", "ml_label", "confidence")
    assert again.exceptAll(model.transform(frame).select("id", "text", "ml_label", "confidence")).isEmpty()
    passes.clear()
    train_text(mixed(spark, 2_000), size=150)
    assert 0 < len(passes) < 60


def test_large_counts_and_one_class(spark, monkeypatch):
    """Counts beyond a byte are kept; a single class is given to every row."""
    monkeypatch.setattr(learn, "FEW_ENTRIES", 0)
    rows = [(i, "aa " * n + "bb", [], "X" if n > 30 else "Y") for i, n in enumerate([1, 2, 3, 4, 300, 400, 500, 70_000])]
    frame = spark.createDataFrame(rows, CASES)
    found = train_text(frame).transform(frame).orderBy("id").collect()
    assert [r["ml_label"] for r in found] == [r["expected_label"] for r in found]
    alone = train_text(frame.where("id < 3")).transform(frame).select("ml_label", "confidence").distinct().collect()
    assert [tuple(r) for r in alone] == [("Y", 100)]
    assert math.isclose(term_arrays.unit_weights(np.array([2]), np.array([0, 1]), np.array([1.0, 3.0]), np.ones(2))[1] @ [1, 0], 1 / math.hypot(1, 1 + math.log(3)))
