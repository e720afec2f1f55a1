"""Learned risk models on Spark ML, as alternatives to the rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.linalg import DenseMatrix, DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from clearwake.functions.risk import FEATURES, featurize
from clearwake.functions.staging import pin
from clearwake.functions.text import enriched_text, word_tokens
from clearwake.operators import softmax
from clearwake.operators.quality import stratified_folds
from clearwake.operators.term_arrays import TermCounter, place_counts, term_counts, unit_weights
from clearwake.session import cut_lineage, scratch_path, spread

# Model settings.
FOREST_TREES = 100
FOREST_DEPTH = 5
FOREST_SEED = 42
VOCABULARY = 5_000
#: Places that terms are counted in by hash, and how many places for each wanted term are looked at first.
TERM_PLACES = 1 << 18
PLACES_PER_TERM = 4
LR_ITERATIONS = 1_000
LR_C = 1.0
TEXT_MAX_FOLDS = 5
#: Terms of all rows up to which Spark's solver, with more but cheaper passes, fits the text model.
FEW_ENTRIES = 1 << 20

MAX_CLASSES = 1_000


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five named model inputs."""
    return df.withColumns(featurize(text, "entities"))


def class_weights(cases: DataFrame, label: str) -> dict[str, float]:
    """Balanced weights n / (k * n_c); a class list is short, and checked to be."""
    counts = cases.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    total = sum(r["count"] for r in counts)
    return {r[label]: total / (len(counts) * r["count"]) for r in counts}


def _weighted(cases: DataFrame, label: str, among: DataFrame | None = None) -> DataFrame:
    """Balanced weights of the labels in ``cases``, or ``among`` other rows."""
    pairs = [F.lit(x) for pair in class_weights(cases if among is None else among, label).items() for x in pair]
    return cases.withColumn("_weight", F.create_map(*pairs)[F.col(label)])


class ForestModel:
    """Random forest over the five features; ``transform`` adds ``ml_label``."""

    def __init__(self, fitted: PipelineModel):
        self.fitted = fitted

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """A row without text or entities has no label."""
        return self._predict(with_features(df, text)).select(*df.columns, "ml_label")

    def _predict(self, inputs: DataFrame) -> DataFrame:
        whole = reduce(and_, (F.col(c).isNotNull() for c in FEATURES))
        filled = inputs.withColumn("_whole", whole).fillna(0, list(FEATURES))
        named = F.when(F.col("_whole"), F.col("ml_label")).alias("ml_label")
        return self.fitted.transform(filled).select(*inputs.columns, named)

    @property
    def feature_importances(self) -> dict[str, float]:
        forest = self.fitted.stages[-2]
        return dict(zip(FEATURES, forest.featureImportances.toArray().tolist()))

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(path)


def train_forest(cases: DataFrame, label: str = "expected_label", text: str = "text") -> ForestModel:
    """A forest of the rows that have a text, entities and a label."""
    return _fit_forest(with_features(cases, text), label)


def _fit_forest(features: DataFrame, label: str) -> ForestModel:
    whole = reduce(and_, (F.col(c).isNotNull() for c in (*FEATURES, label)))
    rows = _weighted(features.where(whole), label)
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="_features"),
        RandomForestClassifier(
            featuresCol="_features",
            labelCol="_label",
            weightCol="_weight",
            numTrees=FOREST_TREES,
            maxDepth=FOREST_DEPTH,
            seed=FOREST_SEED,
        ),
        IndexToString(inputCol="prediction", outputCol="ml_label", labels=indexer.labels),
    ]
    return ForestModel(Pipeline(stages=stages).fit(indexer.transform(rows)))


def load_model(path: str) -> ForestModel | None:
    """A stored forest, or None (score by rules) if there is none that can be read."""
    if not path:
        return None
    try:
        return ForestModel(PipelineModel.load(path))
    except Exception as exc:  # the JVM reports a missing or broken model in several ways
        print(f"model load failed ({type(exc).__name__}), rules will be used")
        return None


def train_accuracy(model, cases: DataFrame, label: str = "expected_label") -> DataFrame:
    return model.transform(cases).agg(F.avg((F.col("ml_label") == F.col(label)).cast("double")).alias("accuracy"))


def out_of_fold(cases: DataFrame, k: int, label: str = "expected_label", key: str = "id", text: str = "text") -> DataFrame:
    """``key, label, fold, ml_label`` of every row, predicted by a forest of the other folds.

    Features and folds are computed once and stored; texts are not read again for any of the ``k`` fits.
    """
    folded = stratified_folds(cases, k, label, key)
    stored = cut_lineage(with_features(folded, text).select(key, label, "fold", *FEATURES))
    parts = []
    for i in range(1, k + 1):
        model = _fit_forest(stored.where(F.col("fold") != i), label)
        parts.append(model._predict(stored.where(F.col("fold") == i)).select(key, label, "fold", "ml_label"))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def fold_report(predictions: DataFrame, label: str = "expected_label") -> DataFrame:
    """``fold, rows, accuracy`` of ``out_of_fold``; a row without a prediction is wrong."""
    right = F.coalesce(F.col("ml_label") == F.col(label), F.lit(False)).cast("double")
    return predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("accuracy"))


def cross_validate(
    cases: DataFrame, k: int, train: Callable[[DataFrame], object], label: str = "expected_label", key: str = "id"
) -> DataFrame:
    """``k, mean_accuracy, std_accuracy`` (population) over stratified folds; features are fitted
    inside each fold."""
    folded = stratified_folds(cases, k, label, key).persist()
    try:
        scores = []
        for i in range(1, k + 1):
            model = train(folded.where(F.col("fold") != i).drop("fold"))
            held_out = folded.where(F.col("fold") == i).drop("fold")
            scores.append(train_accuracy(model, held_out, label).first()["accuracy"])
    finally:
        folded.unpersist()
    frame = cases.sparkSession.createDataFrame([(s,) for s in scores], "accuracy double")
    return frame.agg(
        F.count("accuracy").alias("k"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
    )


# -- text features -------------------------------------------------------------------------------


def term_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term``: words of two or more characters and their bigrams, one row per occurrence."""
    words = df.select(key, word_tokens(text, 2).alias("word"))
    following = F.slice("word", F.lit(2), F.size("word")).alias("next")
    pairs = words.select(key, F.inline(F.arrays_zip("word", following)).alias("word", "next"))
    bigram = F.concat("word", F.lit(" "), "next")  # null after the last word
    return pairs.select(key, F.explode(F.array("word", bigram)).alias("term")).where("term IS NOT NULL")


def top_terms(rows: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """``term``: the most frequent terms, ties in term order; at most ``size`` rows.

    Occurrences are first counted in ``TERM_PLACES`` places, by hash, so no task holds all terms. The terms of the fullest
    places are counted one by one. A place with fewer occurrences than the last term found has no better one; if others are
    left, they are counted too.
    """
    place = F.pmod(F.xxhash64("term"), F.lit(TERM_PLACES)).alias("_place")

    def counted(chosen: DataFrame) -> DataFrame:
        # at most TERM_PLACES numbers
        possible = rows.select("term", place).join(F.broadcast(chosen.select("_place")), "_place", "left_semi")
        return possible.groupBy("term").agg(F.count(F.lit(1)).alias("_cf"))

    return _best_terms(rows.groupBy(place).agg(F.count(F.lit(1)).alias("_n")), counted, size)


def top_text_terms(df: DataFrame, text: str, size: int = VOCABULARY) -> DataFrame:
    """``top_terms`` of the words and bigrams of a text, counted inside the task without a row for each."""
    words = df.select(_words(text).alias("words"))

    def counted(chosen: DataFrame) -> DataFrame:
        held = np.zeros(TERM_PLACES, bool)
        held[[r["_place"] for r in chosen.select("_place").collect()]] = True
        return words.mapInArrow(term_counts(held), "term string, _n bigint").groupBy("term").agg(F.sum("_n").alias("_cf"))

    places = words.mapInArrow(place_counts(TERM_PLACES), "_place bigint, _n bigint")
    return _best_terms(places.groupBy("_place").agg(F.sum("_n").alias("_n")), counted, size)


def _words(text: str) -> Column:
    return F.coalesce(word_tokens(text, 2), F.array().cast("array<string>"))


def _best_terms(places: DataFrame, counted: Callable[[DataFrame], DataFrame], size: int) -> DataFrame:
    """From ``_place, _n``, and ``term, _cf`` of the terms of some places."""
    places = cut_lineage(places)

    def best(chosen: DataFrame) -> DataFrame:
        return cut_lineage(counted(chosen).orderBy(F.desc("_cf"), "term").limit(size))

    fullest = cut_lineage(places.orderBy(F.desc("_n"), "_place").limit(PLACES_PER_TERM * size))
    found = best(fullest)
    least = found.agg(F.min("_cf")).first()[0] if found.count() == size else 0
    left = places.where(F.col("_n") >= least)
    if not left.join(fullest, "_place", "left_anti").isEmpty():
        found = best(left)
    return found.select("term")


def _listed(terms: DataFrame, order: str) -> list[str]:
    """The terms of a vocabulary, which is cut to a fixed number of rows."""
    return [r["term"] for r in terms.orderBy(order).select("term").collect()]


def term_entries(df: DataFrame, terms: list[str], text: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``entries``: index and count of the listed terms in a text, by index.

    Terms are counted inside the row, so neither texts nor terms are exchanged or held by a task.
    """
    counter = TermCounter(terms)
    count = F.arrow_udf(counter.lists, "array<struct<i:int,tf:double>>")
    return df.select(*keep, count(_words(text)).alias("entries"))


def _one_per_key(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``key, entries`` with the counts of rows that share a key (or have none) added up, and those keys with their
    number of ``copies``, if there are any. Rows with a key of their own are not exchanged for it."""
    repeated = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    if repeated.isEmpty():
        return rows.select(key, "entries"), None
    other = repeated.withColumnRenamed(key, "_other")
    same = F.col(key).eqNullSafe(F.col("_other"))
    once = rows.join(other, same, "left_anti").select(key, "entries")
    # one row per key and term of the vocabulary
    parts = rows.join(other, same, "left_semi").select(key, F.inline_outer("entries")).groupBy(key, "i").agg(F.sum("tf").alias("tf"))
    entry = F.when(F.col("i").isNotNull(), F.struct("i", "tf"))
    added = parts.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return once.unionByName(added), repeated


def vocabulary(counts: DataFrame, terms: list[str], documents: int) -> DataFrame:
    """``i, term, idf`` of the listed terms, from the ``entries`` of each key."""
    idf = F.log((1.0 + documents) / (1.0 + F.count(F.lit(1)))) + 1.0
    found = counts.select(F.explode("entries.i").alias("i")).groupBy("i").agg(idf.alias("idf")).collect()
    rows = [(r["i"], terms[r["i"]], r["idf"]) for r in sorted(found)]
    return counts.sparkSession.createDataFrame(rows, "i int, term string, idf double")


def weigh(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``entries`` with a ``weight`` instead of a count: sublinear tf times idf, unit length per row."""
    # as long as the vocabulary
    idf = F.lit(np.array([r["idf"] for r in vocab.orderBy("i").collect()], dtype=float))
    others = [c for c in counts.columns if c != "entries"]
    raw = F.transform(
        "entries", lambda e: F.struct(e["i"].alias("i"), ((1.0 + F.log(e["tf"].cast("double"))) * F.get(idf, e["i"])).alias("w"))
    )
    weighted = pin(counts.select(*others, raw.alias("_raw")), "_raw")
    square = F.aggregate("_raw", F.lit(0.0), lambda total, e: total + e["w"] * e["w"])
    # once for each row, not for each entry
    measured = pin(weighted.select(*others, "_raw", F.sqrt(square).alias("_norm")), "_norm")
    unit = F.transform("_raw", lambda e: F.struct(e["i"].alias("i"), (e["w"] / F.col("_norm")).alias("weight")))
    return measured.select(*others, unit.alias("entries"))


def _fit_terms(df: DataFrame, key: str, text: str, size: int, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Stored ``key, keep, entries`` of every row; the same per key; the vocabulary; the repeated keys."""
    terms = _listed(top_text_terms(df, text, size), "term")
    path = scratch_path(df.sparkSession, "terms")
    term_entries(df, terms, text, key, *keep).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts, repeated = _one_per_key(rows, key)
    return rows, counts, vocabulary(counts, terms, rows.count()), repeated


def tfidf(df: DataFrame, key: str, text: str = "text", size: int = VOCABULARY) -> DataFrame:
    """``key, term, weight`` of the ``size`` most frequent words and bigrams."""
    _, counts, vocab, _ = _fit_terms(df, key, text, size)
    weights = weigh(counts, vocab).select(key, F.inline("entries"))
    return weights.join(F.broadcast(vocab), "i").select(key, "term", "weight")


_VECTOR = StructType([StructField("v", VectorUDT())])


def _sparse(size: int, entries: Column) -> Column:
    """Pack (index, weight) pairs, sorted by index, as a sparse ML vector."""
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["i"]).alias("indices"),
        F.transform(entries, lambda e: e["weight"]).alias("values"),
    )
    return F.from_json(F.to_json(F.struct(stored.alias("v"))), _VECTOR)["v"]


class TextModel:
    """TF-IDF and multinomial logistic regression; ``transform`` adds ``ml_label`` and ``confidence``."""

    def __init__(self, vocab: DataFrame, size: int, classifier, labels: list[str]):
        self.vocab, self.size, self.classifier, self.labels = vocab, size, classifier, labels

    def transform(self, df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """Each row has the label of its own text; one without a text, or with a null ``key``, has none."""
        usable = F.col(text).isNotNull() & (F.col(key).isNotNull() if key in df.columns else F.lit(True))
        found = self._scorer()(_words(enriched_text(text, "entities")))
        names = F.array(*(F.lit(name) for name in self.labels))
        label = F.when(usable, F.get(names, found["label"]))
        confidence = F.when(usable, F.floor(found["probability"] * 100).cast("int"))
        return df.select(*df.columns, label.alias("ml_label"), confidence.alias("confidence"))

    def _scorer(self) -> Callable[[Column], Column]:
        """Place of the most probable label, and its probability, from the words of a text."""
        counter = TermCounter(_listed(self.vocab, "i"))
        # as long as the vocabulary
        idf = np.array([r["idf"] for r in self.vocab.orderBy("i").collect()], dtype=float)
        coefficients, intercepts = self.classifier.coefficientMatrix.toArray(), self.classifier.interceptVector.toArray()

        def score(words: pa.Array) -> pa.Array:
            lengths, terms, counts = counter.count(words)
            row, weights, _ = unit_weights(lengths, terms, counts, idf)
            margins = np.array([np.bincount(row, weights * c.take(terms), minlength=len(lengths)) + i for c, i in zip(coefficients, intercepts)])
            top = margins.max(axis=0)
            # a model of one class has no other margin than infinity
            share = np.exp(np.where(margins == top, 0.0, margins - top)).sum(axis=0)
            return pa.StructArray.from_arrays([pa.array(margins.argmax(axis=0), pa.int32()), pa.array(1.0 / share)], ["label", "probability"])

        return F.arrow_udf(score, "struct<label:int,probability:double>")

    def save(self, path: str) -> None:
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        names = [(i, name) for i, name in enumerate(self.labels)]
        self.vocab.sparkSession.createDataFrame(names, "i int, label string").coalesce(1).write.mode(
            "overwrite"
        ).json(f"{path}/labels")


def train_text(
    cases: DataFrame, label: str = "expected_label", key: str = "id", text: str = "text", size: int = VOCABULARY
) -> TextModel:
    """A model of the rows that have a key, a text and a label."""
    cases = cases.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(label).isNotNull())
    source = cases.select(key, label, enriched_text(text, "entities").alias("_text"))
    stored, counts, vocab, repeated = _fit_terms(source, key, "_text", size, label)
    width, total = max(vocab.count(), 1), stored.count()
    if repeated is None:
        counted = stored
    else:
        # every row of a key has the counts of all of them, once for each
        copies = counts.join(repeated, key, "left").select(key, "entries", F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int"))))
        counted = stored.select(key, label).join(copies.select(key, "entries"), key)
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(stored.select(label))
    rows = indexer.transform(_weighted(counted, label, stored.select(label)))
    regularization, classes = 1.0 / (LR_C * total), len(indexer.labels)
    entries, most = rows.agg(F.sum(F.size("entries")), F.max(F.array_max("entries.tf"))).first()
    # a single class has nothing to fit
    if (entries or 0) <= FEW_ENTRIES or classes < 2:
        classifier = _fit_by_spark(weigh(rows, vocab), width, regularization)
    else:
        classifier = _fit_in_passes(spread(rows, key), vocab, int(most), classes, regularization)
    return TextModel(vocab, width, classifier, indexer.labels)


def _fit_by_spark(weighted: DataFrame, width: int, regularization: float) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol="_features",
        labelCol="_label",
        weightCol="_weight",
        family="multinomial",
        maxIter=LR_ITERATIONS,
        regParam=regularization,
        standardization=False,
    ).fit(weighted.select("_label", "_weight", _sparse(width, F.col("entries")).alias("_features")))


def _fit_in_passes(rows: DataFrame, vocab: DataFrame, most: int, classes: int, regularization: float) -> LogisticRegressionModel:
    """The minimum of the same objective, in a number of passes that doesn't grow with the rows."""
    spark = rows.sparkSession
    idf = np.array([r["idf"] for r in vocab.orderBy("i").collect()], dtype=float)
    path = scratch_path(spark, "fit")
    parts = rows.select(F.col("_label").alias("label"), F.col("_weight").alias("weight"), "entries.i", "entries.tf")
    parts.mapInArrow(softmax.packed(idf, most), softmax.STORED).write.parquet(path)
    coefficients, intercepts = softmax.fit(spark.read.parquet(path), idf, most, classes, regularization, LR_ITERATIONS)
    context = spark.sparkContext
    matrix = _py2java(context, DenseMatrix(classes, len(idf), coefficients.ravel(), isTransposed=True))
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    name = LogisticRegression().uid
    return LogisticRegressionModel(made(name, matrix, _py2java(context, DenseVector(intercepts)), classes, True))


def load_text_model(spark: SparkSession, path: str) -> TextModel | None:
    """A stored text model, or None if there is none that can be read."""
    try:
        vocab = spark.read.schema("i int, term string, idf double").parquet(f"{path}/vocabulary")
        labels = spark.read.schema("i int, label string").json(f"{path}/labels").orderBy("i").collect()
        classifier = LogisticRegressionModel.load(f"{path}/classifier")
    except Exception as exc:  # the JVM reports a missing or broken model in several ways
        print(f"model load failed ({type(exc).__name__})")
        return None
    return TextModel(vocab, classifier.numFeatures, classifier, [r["label"] for r in labels])


def text_folds(labels: int) -> int:
    return min(TEXT_MAX_FOLDS, labels)
