import zlib

import pytest
from pyspark.sql import functions as F

from clearwake.llm import toxicity as tx

TABLES = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return tx.fit(*tables)


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    rows = tx.query(spark, TABLES).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    toxic = [r for r in unseen if r["toxic"] == 1]
    ordinary = [r for r in unseen if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) > 0.6 * len(toxic)
    assert sum(r["predicted"] for r in ordinary) < 0.006 * len(ordinary)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert docs.count() == tx.query(spark, TABLES).count()


def test_held_out_labels_change_nothing(tables, model):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.fit(docs, turned) == model


def test_equals_plain_scores(spark, model):
    """Whole texts, window by window; neither ids nor other columns matter."""
    words = "the and of trash in worthless on idiot"
    texts = [None, "", " \n\t", "#$%", "one", words, words.upper(), words, "Überall " * 9, words + " filler" * 400_000, "x" * 3_000_000]
    rows = [(i if i != 2 else None, t, "a", 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, score double").repartition(3)
    found = tx.score(df, model, ("doc_id", "text", "row", "score")).collect()
    assert len(found) == len(texts)
    plain, both = tx._compressor(model.ordinary + b"\n" * len(model.toxic)), tx._compressor(model.ordinary + model.toxic)
    for r in found:
        total, n = 0.0, 0
        for segment in tx.words_of((r["row"]["text"] or "").encode()):
            for w in tx.windows(segment):
                gain = len(plain.compress(w)) - len(both.compress(w))
                total += model.evidence[min(max(gain, tx.LOW_GAIN), tx.HIGH_GAIN) - tx.LOW_GAIN]
                n += 1
        assert r["evidence"] == pytest.approx(total) and r["n_windows"] == n
        assert r["score"] == pytest.approx(float(model.probability(total)))
        assert (r["row"]["row"], r["row"]["score"]) == ("a", 0.5)
    by_text = {}
    for r in found:
        by_text.setdefault((r["row"]["text"] or "").lower(), set()).add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
    toxic = next(r for r in found if r["row"]["text"] == words)
    harmless = next(r for r in found if r["row"]["text"] == "one")
    assert toxic["score"] > 4 * harmless["score"] and toxic["worst_window"] in words


def test_segments_hold_all_words():
    text = ("ab cd, " * 400_000 + "y" * 5_000_000 + " Zz").encode()
    parts = list(tx.words_of(text))
    assert b"".join(w for p in parts for w in p) == b"abcd" * 400_000 + b"y" * 5_000_000 + b"zz"
    assert tx.windows([]) == [] and tx.windows([b"a"] * 9) == [b" a a a a ", b" a "]


def test_windows_are_cut_not_lost():
    assert b"".join(tx.windows([b"q" * 10, b"r" * 600])).strip() == b"q" * 10 + b" " + b"r" * 600


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tx.score(docs, tx.fit(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(i, 0) for i in range(30)] + [(3, 1), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    assert max(r["score"] for r in tx.score(docs, tx.fit(docs, some)).collect()) < 0.2
    mixed = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in tx.score(docs, tx.fit(docs, mixed)).collect())
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), mixed)).collect() == []


def test_unclear_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(0, 0), (2, 1), (3, 7)], "doc_id long, toxic int")
    used = {t for t, _, _ in tx.training_rows(docs, labels)}
    assert used == {f"t{i}".encode() for i in range(1, 40) if not held(i)}


def test_near_copies_train_once():
    text = " ".join(f"w{i}" for i in range(300)).encode()
    copies = [text, text + b" more", b"others entirely", b"", text]
    assert [len(x) for x in tx.without_near_copies(copies)] == [300, 2, 0]
