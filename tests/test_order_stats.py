"""Exact ranks against brute force, with groups on both sides of the small-group limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwake.operators import order_stats
from clearwake.operators.order_stats import at_ranks, quantile
from clearwake.operators.quality import stratified_folds


@pytest.mark.parametrize("small", [0, 10**9])
@pytest.mark.parametrize("shape", ["uniform", "one value", "few values", "heavy tail"])
def test_quantiles(spark, monkeypatch, small, shape):
    monkeypatch.setattr(order_stats, "SMALL_GROUP", small)
    rng = np.random.default_rng(7)
    n = 30_000
    values = {
        "uniform": rng.random(n),
        "one value": np.where(rng.random(n) < 0.9, 3.0, rng.random(n)),
        "few values": rng.integers(0, 4, n).astype(float),
        "heavy tail": np.exp(rng.normal(0, 6, n)),
    }[shape]
    keys = rng.integers(0, 3, n) ** 2
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "k int, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["quantile"] for r in quantile(df, ["k"], "v", q).collect()}
        for k in set(keys.tolist()):
            assert got[k] == pytest.approx(np.quantile(values[keys == k], q), rel=1e-12)


def test_null_values_and_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "k string, v double")
    assert {r["k"]: (r["n"], r["quantile"]) for r in quantile(df, ["k"], "v", 0.5).collect()} == {None: (2, 2.0), "a": (1, 5.0)}


def test_rank_outside_the_group_is_null(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "k string, v long")
    row = at_ranks(df, ["k"], "v", [0.0, 1.0], lambda n: [F.lit(4), F.lit(5)]).first()
    assert (row["rank_0"], row["rank_1"]) == (4, None)
    with pytest.raises(ValueError):
        at_ranks(df, [], "v", [0.5], lambda n: [n])


def test_folds_of_a_label_that_is_most_of_the_rows(spark, monkeypatch):
    """Same blocks as numbering every row, with the sketch path forced."""
    monkeypatch.setattr(order_stats, "SMALL_GROUP", 10_000)
    df = spark.range(60_000).select(
        ((F.col("id") * 7919) % 1_000_003).alias("id"),
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "warm").otherwise("cold").alias("expected_label"),
    )
    df.createOrReplaceTempView("folded_cases")
    want = spark.sql("SELECT id, expected_label, ntile(4) OVER (PARTITION BY expected_label ORDER BY id) AS fold FROM folded_cases")
    got = stratified_folds(df, 4).select("id", "expected_label", "fold")
    assert got.exceptAll(want).count() == 0 and got.count() == 60_000


SHAPES = {
    "magnitudes": lambda rng, n: rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n),
    "few far out": lambda rng, n: np.where(rng.random(n) < 1e-3, 1e300, rng.normal(0, 1e-6, n)),
    "neighbours": lambda rng, n: 1.0 + rng.integers(0, 50, n) * np.finfo(float).eps,
    "endless": lambda rng, n: rng.choice([-np.inf, np.inf, 0.0, -0.5, 1.7976931348623157e308], n),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("limit, bins", [(0, 16), (50, 1024)])
def test_ranks_of_hard_values(spark, monkeypatch, shape, limit, bins):
    """With hardly any rows ordered; also where the sketch's guess is wrong."""
    monkeypatch.setattr(order_stats, "SMALL_GROUP", limit)
    monkeypatch.setattr(order_stats, "BINS", bins)
    values = np.sort(SHAPES[shape](np.random.default_rng(1), 3000))
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double").repartition(5)
    wanted = [0, 1, 1499, 2750, 2999]
    row = at_ranks(df, ["k"], "v", [0.9, 0.0, 0.5, 0.1, 1.0], lambda n: [F.lit(r) for r in wanted]).first()
    assert [row[f"rank_{i}"] for i in range(5)] == [values[r] for r in wanted] and row["n"] == 3000


def test_ranks_of_large_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "SMALL_GROUP", 10)
    values = [2**62 + (i * 7919) % 5000 for i in range(5000)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v long")
    row = at_ranks(df, ["k"], "v", [0.5] * 4, lambda n: [F.lit(r) for r in (0, 1, 2500, 5001)]).first()
    assert [row[f"rank_{i}"] for i in range(4)] == [sorted(values)[r] for r in (0, 1, 2500, 5001)]


def test_no_task_orders_a_group(spark, monkeypatch):
    """What reaches the windows is bins and few rows, however many rows a group has."""
    monkeypatch.setattr(order_stats, "SMALL_GROUP", 100)
    monkeypatch.setattr(order_stats, "BINS", 64)
    seen, ordered = [], order_stats._ordered

    def watched(present, keys, brackets):
        seen.append([r["_inside"] for r in brackets.where("_low < _high").collect()])
        return ordered(present, keys, brackets)

    monkeypatch.setattr(order_stats, "_ordered", watched)
    df = spark.range(200_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 200_003).alias("v"))
    got = quantile(df, ["k"], "v", 0.95).first()["quantile"]
    assert got == pytest.approx(np.quantile([(i * 7919) % 200_003 for i in range(200_000)], 0.95))
    assert all(n <= 100 for counts in seen for n in counts)


def test_no_numbers(spark):
    df = spark.createDataFrame([("a", float("nan"), "x"), ("a", 2.0, "y"), ("b", None, "z")], "k string, v double, s string")
    assert [tuple(r) for r in quantile(df, ["k"], "v", 0.5).collect()] == [("a", 1, 2.0)]
    assert quantile(df.limit(0), ["k"], "v", 0.5).collect() == []
    with pytest.raises(TypeError):
        quantile(df, ["k"], "s", 0.5)
