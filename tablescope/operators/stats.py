"""Grouped statistics, value counts and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (col_of, missing_as_null, numeric_columns, require_columns, require_numeric)
from ..functions.comoments import correlations
from ..functions.exprs import mean_of, pct, std_of, sum_of

GROUP_FUNCS = ("sum", "mean", "count", "std")


def group_stats(df: DataFrame, key: str, value: str, func: str) -> DataFrame:
    """One aggregate of ``value`` per ``key``: sum | mean | count | std.

    Rows with a missing key are dropped (pandas groupby, D4); the sum of only
    missing values is 0 (D3); ``count`` counts present values; ``std`` divides
    by n-1. Sorted by the result descending (NULL last), then key. Output
    columns: ``key``, ``<func>``. Partial aggregation runs map-side, so a hot
    key costs one row per partition in the shuffle.
    """
    if func not in GROUP_FUNCS:
        raise ValueError(f"unknown func '{func}'; use one of {list(GROUP_FUNCS)}")
    require_columns(df, key, value)
    if func != "count":
        require_numeric(df, value)
    dt = df.schema[value].dataType
    v = missing_as_null(df, value)
    agg = {
        "sum": lambda: sum_of(v, dt),
        "mean": lambda: mean_of(v, dt),
        "count": lambda: F.count(v),
        "std": lambda: std_of(v, dt),
    }[func]()
    out = df.where(missing_as_null(df, key).isNotNull()).groupBy(col_of(key)).agg(agg.alias(func))
    return out.orderBy(F.col(func).desc_nulls_last(), col_of(key).asc())


def group_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """A1 all at once: ``(key, sum, mean, count, std)`` per present key, one
    partial+final aggregation (same rules as ``group_stats``)."""
    require_columns(df, key, value)
    require_numeric(df, value)
    dt = df.schema[value].dataType
    v = missing_as_null(df, value)
    return df.where(missing_as_null(df, key).isNotNull()).groupBy(col_of(key)).agg(
        sum_of(v, dt).alias("sum"), mean_of(v, dt).alias("mean"), F.count(v).alias("count"),
        std_of(v, dt).alias("std"))


def ranked(summary: DataFrame, key: str, func: str) -> DataFrame:
    """One statistic of a ``group_summary`` in ``group_stats`` order."""
    if func not in GROUP_FUNCS:
        raise ValueError(f"unknown func '{func}'; use one of {list(GROUP_FUNCS)}")
    return summary.select(col_of(key), func).orderBy(F.col(func).desc_nulls_last(), col_of(key).asc())


def value_counts(df: DataFrame, col: str, n: int | None = 20, digits: int = 2) -> DataFrame:
    """Top ``n`` values of ``col`` by count with their share of all present values.

    ``pct`` is 100 * count / (rows where ``col`` is present), rounded half-up to
    ``digits``; ties in count go to the smaller value. The total is one counted
    scalar applied as a literal; the top-k is a ``TakeOrderedAndProject``.
    """
    require_columns(df, col)
    present = df.select(missing_as_null(df, col).alias(col)).where(col_of(col).isNotNull())
    total = present.count()  # one scalar, used as a literal
    counts = present.groupBy(col_of(col)).agg(F.count(F.lit(1)).alias("count"))
    ranked = counts.orderBy(F.col("count").desc(), col_of(col).asc())
    if n is not None:
        ranked = ranked.limit(n)
    return ranked.select(col_of(col), "count", pct(F.col("count"), F.lit(total), digits).alias("pct"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, long form
    ``(col_x, col_y, ix, iy, r)``.

    Pairwise complete (rows where both are present), NULL for a constant column
    (instead of an ANSI divide error), 1.0 on the diagonal of a non-constant
    column. Pairs of integer and decimal columns are exact, whatever their size and
    however many columns there are. One pass, see ``functions/comoments.py``.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    for c in cols:
        require_numeric(df, c)
    if not cols:
        raise ValueError("no numeric columns for correlation")
    names = F.array(*[F.lit(c) for c in cols])
    return correlations(df, cols).select(F.element_at(names, F.col("ix") + 1).alias("col_x"),
                                         F.element_at(names, F.col("iy") + 1).alias("col_y"), "ix", "iy", "r")


def strong_correlations(df: DataFrame, cols: Sequence[str] | None = None,
                        threshold: float = 0.5, digits: int = 3) -> DataFrame:
    """Pairs above the diagonal with ``|r| > threshold`` (NaN/NULL left out), r rounded to ``digits``."""
    m = correlation_matrix(df, cols)
    return (m.where((F.col("ix") < F.col("iy")) & (F.abs("r") > F.lit(threshold)))
            .select("col_x", "col_y", F.round("r", digits).alias("r")))
