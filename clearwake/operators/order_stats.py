"""Exact order statistics per group without ordering a group in one task.

A rank sketch guesses a bracket around each wanted rank. Then values are counted in bins, by partial aggregation: below the
bracket, in equal steps inside it, and above it. Exact counts tell which bin has the rank, wherever the guess was wrong, and
that bin, cut to the values in it, is the next bracket. This is repeated until a bracket is one value or holds at most
``SMALL_GROUP`` rows, which are merged by value and ordered. So a task orders ``BINS`` counts or ``SMALL_GROUP`` rows for a
group and rank at most, however large the group is, and every round divides what is left by up to ``BINS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwake.session import broadcast_if_small, cut_lineage

# The sketch finds a rank within n / ACCURACY; the first brackets reach three times as far.
ACCURACY = 10_000
_MARGIN = 3.0 / ACCURACY
# Brackets of up to so many rows are ordered (after equal values were merged).
SMALL_GROUP = 100_000
BINS = 1024
_LARGEST = 1.7976931348623157e308


def _distance(floating: bool, spread: bool) -> Callable[[Column, Column], Column]:
    """How far a value is from another, as a number that rises with the value."""
    if not floating:
        # exact, also between large whole numbers
        return lambda a, b: (a.cast("decimal(38,6)") - b.cast("decimal(38,6)")).cast("double")

    def finite(x: Column) -> Column:
        return F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), x.cast("double")))

    if not spread:
        return lambda a, b: finite(a) - finite(b)

    def magnitude(x: Column) -> Column:
        # 800 lifts the logarithms of the smallest numbers above zero
        size = F.ln(F.abs(finite(x))) + F.lit(800.0)
        return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x.cast("double")) * size)

    return lambda a, b: magnitude(a) - magnitude(b)


def _bin(value: Column, low: Column, high: Column, distance: Callable[[Column, Column], Column]) -> Column:
    """-1 below ``low``, ``BINS`` above ``high``, else a number that rises with the value; the ends are never in one bin."""
    share = F.try_divide(distance(value, low), distance(high, low))
    step = F.least(F.lit(BINS - 2), F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)))
    return (
        F.when(value < low, F.lit(-1)).when(value > high, F.lit(BINS)).when(value == high, F.lit(BINS - 1)).otherwise(step)
    ).cast("int")


def at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    ranks: Callable[[Column], Sequence[Column]],
) -> DataFrame:
    """One row per group: ``keys``, ``n`` and ``rank_0 .. rank_m``.

    ``ranks(n)`` gives the wanted 0-based ranks for a group of ``n`` rows, and
    ``fractions[i]`` the relative position of the i-th one, where the search starts. A rank outside the group is null.
    Null values, and those that are no number, don't count. ``value`` is numeric.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("at least one key column is needed")
    kind = df.schema[value].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{value} is {kind.simpleString()}, not a number")
    floating = isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)
    usable = F.col(value).isNotNull() & (~F.isnan(value) if floating else F.lit(True))
    present = df.where(usable).select(*keys, F.col(value).alias("_v"))

    cuts = [x for f in fractions for x in (max(0.0, f - _MARGIN), min(1.0, f + _MARGIN))]
    sizes = cut_lineage(
        present.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.percentile_approx("_v", cuts, ACCURACY).alias("_cuts"),
        )
    )
    small = F.col("n") <= SMALL_GROUP
    wanted = [
        F.struct(
            F.lit(i).alias("_i"),
            rank.cast("long").alias("_rank"),
            F.lit(0).cast("long").alias("_below"),
            F.when(small, F.col("_min")).otherwise(F.col("_cuts")[2 * i].cast(kind)).alias("_low"),
            F.when(small, F.col("_max")).otherwise(F.col("_cuts")[2 * i + 1].cast(kind)).alias("_high"),
            F.col("n").alias("_inside"),
        )
        for i, rank in enumerate(ranks(F.col("n")))
    ]
    start = sizes.select(*keys, "n", F.inline(F.array(*wanted)))
    brackets = start.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("n"))).drop("n")
    brackets = _narrow(present, keys, brackets, floating)
    found = _ordered(present, keys, brackets)
    picks = [F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(f"rank_{i}") for i in range(len(wanted))]
    # groups whose ranks are all outside have a row too
    none = sizes.select(*keys, F.lit(-1).alias("_i"), F.lit(None).cast(kind).alias("_value"), "n")
    rows = found.select(*keys, "_i", "_value", F.lit(None).cast("long").alias("n")).unionByName(none)
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    return out.select(*keys, "n", *(f"rank_{i}" for i in range(len(wanted))))


def _inside(present: DataFrame, keys: list[str], brackets: DataFrame, whole: bool = False) -> DataFrame:
    """Each value next to the brackets of its group that it lies in, or to all of them."""
    named = brackets.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in brackets.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    within = [] if whole else [F.col("_v").between(F.col("_low"), F.col("_high"))]
    return present.join(broadcast_if_small(named), reduce(and_, [*same, *within])).drop(*(f"_k_{k}" for k in keys))


def _narrow(present: DataFrame, keys: list[str], brackets: DataFrame, floating: bool) -> DataFrame:
    """The brackets, each cut down to one value or ``SMALL_GROUP`` rows."""
    wide = (F.col("_inside") > SMALL_GROUP) & (F.col("_low") <= F.col("_high"))
    first = True
    while True:
        brackets = cut_lineage(brackets)
        # after the first round, which checks the sketch's guess, one value is enough
        open_ = brackets.where(wide if first else wide & (F.col("_low") < F.col("_high")))
        count = open_.count()
        if not count:
            return brackets
        closed = brackets.where(~(wide if first else wide & (F.col("_low") < F.col("_high"))))
        # sizes may lie many powers apart at first
        place = _bin(F.col("_v"), F.col("_low"), F.col("_high"), _distance(floating, first))
        counted = (
            _inside(present, keys, open_, whole=first)
            .groupBy(*keys, "_i", "_rank", "_below", place.alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        )
        before = Window.partitionBy(*keys, "_i").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_inside").over(before), F.lit(0)))
        has = (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_inside"))
        hit = cut_lineage(placed.where(has).select(*brackets.columns))
        if hit.count() != count:
            raise RuntimeError("the rows changed between two reads: counts don't add up")
        brackets = closed.unionByName(hit)
        first = False


def _ordered(present: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """``keys, _i, _value`` from brackets of few rows or one value."""
    single = F.col("_low") == F.col("_high")
    upto = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        _inside(present, keys, brackets.where(~single))
        .groupBy(*keys, "_i", "_rank", "_below", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.col("_below") + F.sum("_c").over(upto))
    )
    picked = steps.where(F.col("_upto") > F.col("_rank")).groupBy(*keys, "_i").agg(F.min("_v").alias("_value"))
    return picked.unionByName(brackets.where(single).select(*keys, "_i", F.col("_low").alias("_value")))


def quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact interpolated quantile per group: ``keys``, ``n`` and ``name``."""

    def position(n: Column) -> Column:
        return F.lit(q) * (n - 1)

    both = at_ranks(
        df,
        keys,
        value,
        [q, q],
        lambda n: [F.floor(position(n)), F.ceil(position(n))],
    )
    share = position(F.col("n")) - F.floor(position(F.col("n")))
    return both.select(
        *keys,
        "n",
        (F.col("rank_0") + (F.col("rank_1") - F.col("rank_0")) * share).alias(name),
    )
