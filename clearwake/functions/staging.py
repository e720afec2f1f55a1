"""Keeping costly columns from being computed more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, *names: str) -> DataFrame:
    """The same rows and columns, with the named columns computed at this point.

    Spark moves a later filter below the projections it refers to by writing their expressions
    into it, so a filter on the outcome of a parse would parse again, several times over. Filters
    are not moved below a generator, and one over a single-element array keeps every row.
    """
    others = [c for c in df.columns if c not in names]
    pinned = df.select(*others, F.inline(F.array(F.struct(*names))))
    return pinned.select(*df.columns)
