"""Scorer evaluation: accuracy gate, per-label metrics, class counts, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwake.operators.enrich import score_rules
from clearwake.operators.order_stats import at_ranks
from clearwake.session import broadcast_if_small

# The accuracy gate, the largest fold count, the smallest pack that is folded.
MIN_ACCURACY = 0.9
MAX_FOLDS = 3
MIN_FOLDED_CASES = 8


def rule_predictions(cases: DataFrame) -> DataFrame:
    """Cases with ``predicted`` and ``score`` from the rule scorer."""
    scored = score_rules(cases.withColumn("entities", F.coalesce("entities", F.array().cast(cases.schema["entities"].dataType))))
    return scored.withColumnsRenamed({"risk_label": "predicted", "risk_score": "score"})


def evaluate(
    cases: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] = rule_predictions,
    min_accuracy: float = MIN_ACCURACY,
) -> DataFrame:
    """One row: ``cases, correct, accuracy, passed``. An empty pack has accuracy 0."""
    right = F.col("predicted") == F.col("expected_label")
    return (
        scorer(cases)
        .agg(F.count(F.lit(1)).alias("cases"), F.count_if(right).alias("correct"))
        .withColumn(
            "accuracy", F.when(F.col("cases") > 0, F.col("correct") / F.col("cases")).otherwise(0.0)
        )
        .withColumn("passed", F.col("accuracy") >= min_accuracy)
    )


def failures(
    cases: DataFrame, scorer: Callable[[DataFrame], DataFrame] = rule_predictions
) -> DataFrame:
    """Wrongly labelled cases: ``name, expected, actual, score``."""
    return (
        scorer(cases)
        .where(~F.col("predicted").eqNullSafe(F.col("expected_label")))
        .select("name", F.col("expected_label").alias("expected"), F.col("predicted").alias("actual"), "score")
    )


def top_failures(failed: DataFrame, count: int = 5, order: str = "name") -> DataFrame:
    """The first failures, for a report."""
    return failed.orderBy(order).limit(count)


def label_metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate per label of ``(expected, predicted)`` rows.

    Rows are counted per label pair first; everything after works on that small matrix.
    """
    pairs = predictions.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        "n",
        F.inline(
            F.array(
                F.struct(F.col("expected").alias("label"), F.lit("e").alias("side"), (F.col("expected") == F.col("predicted")).alias("hit")),
                F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side"), (F.col("expected") == F.col("predicted")).alias("hit")),
            )
        ),
    )
    per_label = sides.groupBy("label").agg(
        F.coalesce(F.sum(F.when((F.col("side") == "e") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when((F.col("side") == "p") & ~F.col("hit"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when((F.col("side") == "e") & ~F.col("hit"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    total = pairs.agg(F.sum("n")).scalar()

    def share(part: str, *whole: str):
        below = sum((F.col(w) for w in whole[1:]), F.col(whole[0]))
        return F.when(below > 0, F.col(part) / below).otherwise(0.0)

    return (
        per_label.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))
        .withColumn("precision", share("tp", "tp", "fp"))
        .withColumn("recall", share("tp", "tp", "fn"))
        .withColumn("false_positive_rate", share("fp", "fp", "tn"))
    )


def class_counts(cases: DataFrame, label: str = "expected_label", max_folds: int = MAX_FOLDS) -> DataFrame:
    """Rows per label, with the smallest class and the fold count it allows."""
    counts = cases.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    smallest = counts.agg(F.min("n")).scalar()
    return counts.withColumn("smallest", smallest).withColumn("folds", F.least(smallest, F.lit(max_folds)))


def stratified_folds(cases: DataFrame, k: int, label: str = "expected_label", key: str = "id") -> DataFrame:
    """Adds ``fold`` (1..k): per label, k contiguous near-equal blocks in ``key`` order.

    Only the k - 1 block starts per label are looked up, exactly; each row is then compared with
    the starts of its label. No label is numbered row by row in one task. ``key`` is numeric and
    unique within a label.
    """
    if k < 2:
        raise ValueError("k must be at least 2")

    def starts(n):
        return [j * F.floor(n / k) + F.least(F.lit(j), n % k) for j in range(1, k)]

    bounds = at_ranks(cases, [label], key, [j / k for j in range(1, k)], starts).drop("n")
    # one row per label
    small = broadcast_if_small(bounds.withColumnRenamed(label, "_label"))
    passed = sum((F.coalesce(F.col(key) >= F.col(f"rank_{j}"), F.lit(False)).cast("int") for j in range(k - 1)), F.lit(1))
    joined = cases.join(small, cases[label].eqNullSafe(small["_label"]), "left")
    return joined.withColumn("fold", passed).select(*cases.columns, "fold")
