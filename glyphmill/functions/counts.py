"""Counts of terms inside a row: sorted arrays and their runs, in place of a shuffle by row and term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.tables import kept


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def occurrences(tokens: Column) -> Column:
    """struct(term, i) of every token of an array of sentences' tokens, sorted by term and sentence."""
    return F.sort_array(F.flatten(F.transform(tokens, lambda ts, i: F.transform(ts, lambda t: F.struct(t.alias("term"), i.alias("i"))))))


def with_runs(df: DataFrame, name: str, column: str, key: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``name``: struct(term, f, a) of each run of equal keys in a sorted array: the key, its length and where it begins."""
    a = F.col(column)
    new = lambda j: (j == 0) | (key(F.get(a, j)) != key(F.get(a, j - 1)))
    df = kept(df, _at=F.filter(upto(F.size(a)), new))
    run = lambda s, k: F.struct(key(F.get(a, s)).alias("term"), (F.coalesce(F.get(F.col("_at"), k + 1), F.size(a)) - s).alias("f"), s.alias("a"))
    return kept(df, **{name: F.transform("_at", run)}).drop("_at")
