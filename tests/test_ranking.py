"""Ranked search, models on rows with nulls and repeated keys, dictionary and route tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clearwake.operators import entities, learn, ranking
from clearwake.operators.access import access_audit
from clearwake.operators.entities import gazetteer_extractor, gazetteer_join
from clearwake.operators.learn import fold_report, out_of_fold, train_forest, train_text
from clearwake.operators.ranking import bm25, read_term_index, term_index, write_term_index
from clearwake.session import scratch_path

ENTITIES = "entities array<struct<text:string,type:string>>"


def test_bm25(spark):
    rng = random.Random(3)
    docs = [(f"d{i}", " ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), [1, 2, 4, 8, 16, 32], k=rng.randint(1, 60)))) for i in range(200)]
    docs += [("none", None), ("empty", ""), ("marks", "... !"), ("twin", docs[0][1])]
    queries = [(1, "Alpha beta"), (2, "GAMMA gamma unknown"), (3, "unknown"), (4, None), (5, "zeta alpha delta")]
    frame = spark.createDataFrame(docs, "id string, content string").repartition(4)
    path = scratch_path(spark, "terms")
    write_term_index(term_index(frame), path)
    found = bm25(read_term_index(spark, path), spark.createDataFrame(queries, "query_id int, text string"), 5)
    bags = {i: Counter(t.split()) for i, t in docs if t and i != "marks"}
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags)
    want = {}
    for q, text in queries:
        scores = []
        for i, bag in bags.items():
            score = 0.0
            for term in set((text or "").lower().split()):
                df = sum(term in c for c in bags.values())
                if bag[term]:
                    idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                    score += idf * bag[term] / (bag[term] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
            if any(bag[t] for t in (text or "").lower().split()):
                scores.append((-round(score, 9), i))
        for rank, (score, i) in enumerate(sorted(scores)[:5], 1):
            want[(q, rank)] = (i, pytest.approx(-score))
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()} == want and (3, 1) not in want
    asked = spark.createDataFrame(queries, "query_id int, text string")
    assert sorted(bm25(term_index(frame, only=asked), asked, 5).collect()) == sorted(found.collect())
    # only the queries' terms are read
    pruned = read_term_index(spark, path).postings.where(F.col("term").isin("alpha"))
    assert "In(term" in (p := pruned._jdf.queryExecution().executedPlan().toString()) or "EqualTo(term" in p


def test_bm25_meets_once_per_document(spark, monkeypatch):
    """No scores of query and document are exchanged and added up; parts of queries, blocks and small shares change nothing."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i % 150:03}" if i else None, " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(200)] + [(None, "w1 w2 w1")]
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in [*range(12), 3]] + [(None, "w1")], "query_id int, text string")
    index = term_index(spark.createDataFrame(docs, "id string, content string").repartition(3))
    found = bm25(index, asked, 7)
    assert "sum(" not in found._jdf.queryExecution().executedPlan().toString().split("mapInArrow")[0].split("MapInArrow")[0]
    whole = sorted(found.collect(), key=str)
    bags = Counter()
    lengths = [(i, len(t.split())) for i, t in docs]
    for (i, length), (_, t) in zip(lengths, docs):
        for w in t.split():
            bags[(i, length, w)] += 1
    asks, df, mean = Counter(), Counter(w for _, _, w in bags), sum(n for _, n in lengths) / len(docs)
    for r in asked.where("query_id IS NOT NULL").collect():
        asks.update((r["query_id"], w) for w in set(r["text"].split()))
    scores = Counter()
    for (q, w), m in asks.items():
        for (i, length, v), tf in bags.items():
            if v == w:
                idf = math.log(1 + (len(docs) - m * df[w] + 0.5) / (m * df[w] + 0.5))
                scores[(q, i)] += m * idf * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    want = {}
    for q in range(12):
        ranked = sorted(((-round(s, 9), i or "") for (p, i), s in scores.items() if p == q))[:7]
        want |= {(q, n): (i or None, pytest.approx(-s)) for n, (s, i) in enumerate(ranked, 1)}
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in whole} == want
    monkeypatch.setattr(ranking, "ROWS_OF_SHARE", 50)
    monkeypatch.setattr(ranking, "POSTINGS_AT_ONCE", 16)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ranking, "SHARE_POSTINGS", 100)
    assert sorted(bm25(index, asked, 7, most_queries=9).collect(), key=str) == whole


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, [], label) for i, t, label in rows], f"id long, text string, {ENTITIES}, expected_label string")


def test_training_leaves_out_what_has_no_text_or_label(spark):
    rows = [(i, "password secret admin" if i % 2 else "quiet plain words", "HIGH" if i % 2 else "LOW") for i in range(30)]
    bad = [(100, None, "HIGH"), (101, "quiet plain words", None), (102, None, None)]
    for train in (train_forest, train_text):
        got = {r["id"]: r["ml_label"] for r in train(labelled(spark, rows + bad)).transform(labelled(spark, rows + bad)).collect()}
        assert [got[i] for i, _, _ in rows] == [label for _, _, label in rows]
        assert got[100] is None and got[101] == "LOW"


def test_rows_of_one_key_have_their_own_labels(spark):
    rows = [(i, "password secret admin" if i % 2 else "quiet plain words", "HIGH" if i % 2 else "LOW") for i in range(30)]
    model = train_text(labelled(spark, rows))
    twice = labelled(spark, [(7, t, label) for _, t, label in rows[:4]] + [(None, "quiet plain words", "LOW")])
    got = [(r["expected_label"], r["ml_label"]) for r in model.transform(twice).collect()]
    assert sorted(got, key=str) == sorted([("HIGH", "HIGH")] * 2 + [("LOW", "LOW")] * 2 + [("LOW", None)], key=str)


def test_text_labels_are_given_inside_the_row(spark, monkeypatch):
    """No text is exchanged for its label; repeated keys don't change the weights of the classes."""
    seen, weights = [], learn.class_weights
    monkeypatch.setattr(learn, "class_weights", lambda cases, label: seen.append(cases.count()) or weights(cases, label))
    rows = [(i // 3 if i < 9 else i, "password secret admin" if i % 2 else "quiet plain words", "HIGH" if i % 2 else "LOW") for i in range(30)]
    frame = labelled(spark, rows)
    found = train_text(frame).transform(frame)
    assert seen == [30]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["ml_label"] for r in found.where("id > 8").orderBy("id").collect()] == [label for i, _, label in rows if i > 8]


def test_out_of_fold(spark):
    rows = [(i, "password secret admin" if i % 2 else "quiet plain words", "HIGH" if i % 2 else "LOW") for i in range(40)]
    rows += [(50, None, "LOW"), (51, "quiet plain words", "HIGH")]
    found = out_of_fold(labelled(spark, rows), 4)
    assert found.count() == 42 and {r["fold"] for r in found.collect()} == {1, 2, 3, 4}
    wrong = {r["id"] for r in found.where("NOT (ml_label <=> expected_label)").collect()}
    assert wrong == {50, 51}
    assert sum(r["rows"] * r["accuracy"] for r in fold_report(found).collect()) == pytest.approx(40)


@pytest.mark.parametrize("slots", [1 << 20, 1 << 10])
def test_dictionary_filter(spark, monkeypatch, slots):
    """No phrase is lost, and few others pass, in a dictionary of any size."""
    monkeypatch.setattr(entities, "FILTER_SLOTS", slots)
    known = spark.range(5000).select(F.concat(F.lit("name"), (F.col("id") * 3).cast("string")).alias("phrase"))
    possible = entities._phrase_filter(known)
    assert known.where(~possible(F.col("phrase"))).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("phrase"))
    assert slots < 1 << 12 or others.where(possible(F.col("phrase"))).count() < 2000
    dictionary = known.withColumn("type", F.lit("ORG"))
    text = spark.createDataFrame([(1, "name3 and name4 met name14997"), (2, None), (3, "nothing here")], "id int, text string")
    got = {r["id"]: [e["text"] for e in r["entities"]] for r in gazetteer_join(text, dictionary, "id", max_words=2).collect()}
    assert got == {1: ["name3", "name14997"], 2: [], 3: []}


def test_table_and_pattern_agree(spark):
    phrases = [("new york", "GPE"), ("york", "GPE"), ("acme", "ORG"), ("acme new york office", "ORG")]
    df = spark.createDataFrame([(1, "acme new york office in york"), (2, "new  york, acme-york"), (3, "")], "id int, text string")
    table = gazetteer_join(df, spark.createDataFrame(phrases, "phrase string, type string"), "id", max_words=4)
    want = {r["id"]: r["entities"] for r in gazetteer_extractor(phrases)(df).collect()}
    assert {r["id"]: r["entities"] for r in table.collect()} == want


def test_routes_of_a_table(spark):
    """Long paths meet as many prefixes as there are lengths; the empty prefix fits all."""
    routes = spark.createDataFrame([("", False, "viewer"), ("/a", False, "admin"), ("/a/b", False, None), ("/a/b", True, "admin"), ("/z", True, None)], "prefix string, exact boolean, required_role string")
    paths = ["/a/b", "/a/bc", "/a/" + "x" * 100_000, "/z", "/zz", "", None]
    requests = spark.createDataFrame([(i, p, "viewer", True) for i, p in enumerate(paths)], "id int, path string, role string, token_ok boolean")
    got = {r["id"]: (r["route"], r["status"]) for r in access_audit(requests, routes).collect()}
    assert got == {0: ("/a/b", 403), 1: ("/a/b", 200), 2: ("/a", 403), 3: ("/z", 200), 4: ("", 200), 5: ("", 200), 6: (None, 404)}
