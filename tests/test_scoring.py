"""Rules, entities, evaluation and learned models."""

import math

import pytest
from pyspark.sql import functions as F

from clearwake.functions.risk import featurize, label_to_score, risk_label
from clearwake.functions.text import RISK_KEYWORDS, enriched_text
from clearwake.operators import learn
from clearwake.operators.enrich import enrich_text, score, score_rules
from clearwake.operators.entities import blank_extractor, gazetteer_extractor, gazetteer_join, model_extractor
from clearwake.operators.learn import (
    cross_validate,
    load_model,
    load_text_model,
    term_rows,
    top_terms,
    text_folds,
    train_accuracy,
    train_forest,
    train_text,
)
from clearwake.operators.quality import class_counts, evaluate, failures, label_metrics, rule_predictions, stratified_folds
from clearwake.schemas import CASES
from clearwake.session import scratch_path

P, O, G = ("Ann", "PERSON"), ("Initech", "ORG"), ("Oslo", "GPE")

# text, entities, score, label
BOUNDARIES = [
    ("monkey", [], 10, "MEDIUM"),
    ("KEY key Key", [], 10, "MEDIUM"),
    ("db_pass", [], 10, "MEDIUM"),
    ("", [], 0, "LOW"),
    ("nothing", [P], 5, "MEDIUM"),
    ("nothing", [P, O, G, P], 20, "HIGH"),
    ("password admin login secret", [P], 45, "HIGH"),
    ("password admin login secret", [P, O], 50, "CRITICAL"),
]

def grid():
    """``name, text, entities, score, label`` for numbers of keywords and entities around the label floors 1, 20 and 50."""
    rows = []
    for hits, people in [(0, 0)] * 5 + [(0, 1), (0, 3), (1, 0), (1, 1), (0, 4), (1, 2), (2, 0), (4, 1), (4, 2), (5, 0), (6, 3), (8, 0), (8, 2)]:
        n = len(rows)
        # neighbouring keywords of the list, from another start in each row
        chosen = [RISK_KEYWORDS[(3 * n + i) % len(RISK_KEYWORDS)] for i in range(hits)]
        text = f"row {n}: " + ", ".join([*chosen, *["plain", "words", "only"][: 1 + n % 3]])
        points = 10 * hits + 5 * people
        label = "CRITICAL" if points >= 50 else "HIGH" if points >= 20 else "MEDIUM" if points else "LOW"
        rows.append((f"grid-{n:02}", text, [(P, O, G)[i % 3] for i in range(people)], points, label))
    return rows


PACK = [(name, text, entities, label) for name, text, entities, _, label in grid()]
PACK_SCORES = [points for *_, points, _ in grid()]


def frame(spark, rows):
    return spark.createDataFrame([(n, t, [tuple(e) for e in es], label) for n, t, es, label in rows], CASES)


def pack(spark, copies=1):
    rows = [(f"{n}-{i}", t, e, label) for i in range(copies) for n, t, e, label in PACK]
    return frame(spark, rows).withColumn("id", F.xxhash64("name"))


def test_boundaries(spark):
    rows = [(str(i), t, e, label) for i, (t, e, _, label) in enumerate(BOUNDARIES)]
    scored = score_rules(frame(spark, rows)).orderBy("name").collect()
    assert [(r["risk_score"], r["risk_label"]) for r in scored] == [(s, label) for _, _, s, label in BOUNDARIES]


def test_pack_scores(spark):
    rows = {r["name"]: r["score"] for r in rule_predictions(frame(spark, PACK)).collect()}
    assert [rows[n] for n, *_ in PACK] == PACK_SCORES


def test_evaluation_gate(spark):
    cases = frame(spark, PACK)
    assert tuple(evaluate(cases).first()) == (18, 18, 1.0, True)
    assert failures(cases).count() == 0
    wrong = frame(spark, [(n, t, e, "LOW") for n, t, e, _ in PACK])
    assert tuple(evaluate(wrong).first()) == (18, 5, pytest.approx(5 / 18), False)
    first = failures(wrong).orderBy("name").first()
    assert tuple(first) == ("grid-05", "LOW", "MEDIUM", 5)
    assert tuple(evaluate(cases.limit(0)).first()) == (0, 0, 0.0, False)


def test_label_helpers(spark):
    df = spark.createDataFrame([(s,) for s in (-5, 0, 1, 19, 20, 49, 50)], "s int")
    assert [r[0] for r in df.select(risk_label("s")).collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    names = spark.createDataFrame([(s,) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL", "other", None)], "l string")
    assert [r[0] for r in names.select(label_to_score("l")).collect()] == [0, 10, 30, 60, 0, 0]


def test_features_and_model_text(spark):
    df = frame(spark, [("a", "Key HTTP://x http@y", [P], "LOW")])
    assert tuple(df.select(*featurize("text", "entities").values()).first()) == (1, 1, 19, 2, 1)
    assert df.select(enriched_text("text", "entities")).first()[0] == "Key HTTP://x http@y __entity_count_1__"
    texts = spark.createDataFrame([(1, "A big, red x balloon"), (2, "x"), (3, "Red big red"), (4, None)], "id long, text string")
    rows = [(r["id"], r["term"]) for r in term_rows(texts, "id", "text").collect()]
    assert sorted(t for i, t in rows if i == 1) == ["balloon", "big", "big red", "red", "red balloon"]
    assert sorted(t for i, t in rows if i == 3) == ["big", "big red", "red", "red", "red big"] and len(rows) == 10
    assert [r["term"] for r in top_terms(term_rows(texts, "id", "text"), 3).collect()] == ["red", "big", "big red"]


PHRASES = [("Ann", "PERSON"), ("Ann Lee", "PERSON"), ("Lee Corp", "ORG"), ("New Oslo", "GPE"), ("Oslo", "GPE"), ("red", "COLOUR")]
TEXTS = {
    "Ann Lee Corp met Ann in New Oslo, not Oslo.": ["Ann Lee", "Ann", "New Oslo", "Oslo"],
    "Annex ann Ann-Lee Ann  Lee red": ["Ann", "Ann"],
    "": [],
    "Lee Corp": ["Lee Corp"],
}


@pytest.mark.parametrize("way", ["pattern", "table"])
def test_gazetteers_agree(spark, way):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    if way == "pattern":
        found = gazetteer_extractor(PHRASES)(df, "text")
    else:
        found = gazetteer_join(df, spark.createDataFrame(PHRASES, "phrase string, type string"), "id", max_words=2)
    rows = {r["id"]: [e["text"] for e in r["entities"]] for r in found.collect()}
    assert [rows[i] for i in range(len(TEXTS))] == list(TEXTS.values())


def test_other_extractors(spark):
    df = spark.createDataFrame([(1, "Ann in Oslo"), (2, None)], "id long, text string")
    assert [r["entities"] for r in blank_extractor(df).collect()] == [[], []]

    def load():
        known = {"Ann": "PERSON", "Oslo": "GPE", "in": "PREP"}
        return lambda text: [(w, known[w]) for w in text.split() if w in known]

    rows = model_extractor(load)(df, "text").orderBy("id").collect()
    assert [(e["text"], e["type"]) for e in rows[0]["entities"]] == [("Ann", "PERSON"), ("Oslo", "GPE")]
    scored = enrich_text(df.where("id = 1"), model_version="m", extractor=model_extractor(load)).first()
    assert (scored["entity_count"], scored["risk_score"], scored["risk_label"]) == (2, 10, "MEDIUM")


class Half:
    @staticmethod
    def transform(df):
        return df.withColumn("ml_label", F.when(F.col("text").contains("a"), "CRITICAL"))


def test_strategies(spark):
    df = frame(spark, [("x", "cat", [], ""), ("y", "key", [], "")])

    def labels(strategy, model):
        return [(r["risk_score"], r["risk_label"]) for r in score(df, strategy, model).orderBy("name").collect()]

    assert labels("rules", Half) == [(0, "LOW"), (10, "MEDIUM")]
    assert labels("auto", None) == labels("ml", None) == labels("rules", None)
    # a row the model gives no label keeps its rule label
    assert labels("auto", Half) == labels("ml", Half) == [(60, "CRITICAL"), (10, "MEDIUM")]
    with pytest.raises(ValueError):
        score(df, "guess")


def test_label_metrics(spark):
    pairs = [("A", "A")] * 3 + [("A", "B")] + [("B", "B")] * 2 + [("C", "A")]
    rows = {r["label"]: r for r in label_metrics(spark.createDataFrame(pairs, "expected string, predicted string")).collect()}
    assert (rows["A"]["tp"], rows["A"]["fp"], rows["A"]["fn"], rows["A"]["tn"]) == (3, 1, 1, 2)
    assert rows["A"]["precision"] == 0.75 and rows["B"]["recall"] == 1.0
    assert (rows["C"]["precision"], rows["C"]["recall"], rows["C"]["false_positive_rate"]) == (0.0, 0.0, 0.0)


def test_class_counts_and_folds(spark):
    few = [row for row in PACK if row[3] != "CRITICAL"] + [row for row in PACK if row[3] == "CRITICAL"][:2]
    counts = class_counts(frame(spark, few)).collect()
    assert {r["label"]: r["n"] for r in counts} == {"LOW": 5, "MEDIUM": 4, "HIGH": 4, "CRITICAL": 2}
    assert {(r["smallest"], r["folds"]) for r in counts} == {(2, 2)}
    rows = [(i, "A" if i < 10 else "B") for i in range(12)]
    folded = stratified_folds(spark.createDataFrame(rows, "id long, expected_label string"), 4)
    by_label = {}
    for r in folded.orderBy("id").collect():
        by_label.setdefault(r["expected_label"], []).append(r["fold"])
    assert by_label == {"A": [1, 1, 1, 2, 2, 2, 3, 3, 4, 4], "B": [1, 2]}


def test_forest(spark):
    cases = pack(spark, 3)
    model = train_forest(cases)
    assert train_accuracy(model, cases).first()["accuracy"] == 1.0
    weights = model.feature_importances
    assert sum(weights.values()) == pytest.approx(1.0) and max(weights, key=weights.get) == "keyword_hits"
    path = scratch_path(spark, "forest")
    model.save(path)
    again = load_model(path).transform(cases).select("id", "ml_label")
    assert again.exceptAll(model.transform(cases).select("id", "ml_label")).count() == 0
    labels = {r["risk_label"] for r in score(cases, "auto", load_model(path)).collect()}
    assert labels == {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    # no model, or none that can be read: rules
    assert load_model("") is None and load_model(path + "-missing") is None


def test_cross_validation(spark):
    result = cross_validate(pack(spark, 2), 2, train_forest).first()
    assert result["k"] == 2 and 0.5 <= result["mean_accuracy"] <= 1.0 and result["std_accuracy"] >= 0.0
    assert text_folds(4) == 4 and text_folds(9) == 5


def test_text_model(spark):
    cases = pack(spark, 3)
    model = train_text(cases)
    predicted = model.transform(cases)
    assert train_accuracy(model, cases).first()["accuracy"] >= 0.9
    low, high = predicted.agg(F.min("confidence"), F.max("confidence")).first()
    assert 25 <= low <= high <= 100
    path = scratch_path(spark, "text")
    model.save(path)
    again = load_text_model(spark, path).transform(cases)
    assert again.select("id", "ml_label", "confidence").exceptAll(predicted.select("id", "ml_label", "confidence")).count() == 0
    assert load_text_model(spark, path + "-missing") is None


def test_models_leave_null_texts_to_the_rules(spark):
    cases = pack(spark, 3)
    rows = cases.drop("id").limit(3).unionByName(
        spark.createDataFrame([("none", None, [], "LOW")], CASES)
    )
    for model in (train_forest(cases), train_text(cases)):
        found = {r["name"]: r["risk_label"] for r in score(rows, "ml", model).collect()}
        assert len(found) == 4
        assert found["none"] == score(rows).where("name = 'none'").first()["risk_label"]


@pytest.mark.parametrize("places, first", [(1 << 18, 4), (64, 4), (64, 1), (1, 1)])
def test_top_terms_of_few_places(spark, monkeypatch, places, first):
    """The same terms, however many share a place: full places without a frequent term hide none."""
    monkeypatch.setattr(learn, "TERM_PLACES", places)
    monkeypatch.setattr(learn, "PLACES_PER_TERM", first)
    bag = {f"w{i}": 1 + i % 41 for i in range(400)}
    rows = spark.createDataFrame([(1, t) for t, n in bag.items() for _ in range(n)], "id int, term string")
    want = sorted(bag, key=lambda t: (-bag[t], t))
    assert [r["term"] for r in top_terms(rows, 20).collect()] == want[:20]
    assert [r["term"] for r in top_terms(rows, 1000).collect()] == want


def test_terms_are_counted_inside_the_row(spark):
    """No task holds the terms of more than a row; rows of one key, or of none, count as one text."""
    texts = [(1, "red big red"), (2, "big"), (2, "red big"), (None, "big"), (None, "blue"), (3, None), (4, "x"), (5, "red")]
    frame = spark.createDataFrame(texts, "id int, text string")
    plan = learn.tfidf(frame.where("id <> 2"), "id", size=4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
    found = learn.tfidf(frame, "id", size=4)
    bags = {1: {"red": 2, "big": 1, "big red": 1, "red big": 1}, 2: {"big": 2, "red": 1, "red big": 1}, None: {"big": 1}, 5: {"red": 1}}
    want = {}
    for key, bag in bags.items():
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + sum(t in b for b in bags.values()))) + 1) for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        want |= {(key, t): pytest.approx(w / norm) for t, w in raw.items()}
    assert {(r["id"], r["term"]): r["weight"] for r in found.collect()} == want
