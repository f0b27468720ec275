"""Most frequent value per column, smallest value on ties, computed without a
value->count map in one task: count (column, value) pairs with a map-side
combined group-by, then keep ``min(struct(-count, value))`` per column, an
algebraic aggregate that is merged partially as well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col_of, is_floating, require_columns


def value_as_text(df: DataFrame, name: str):
    """A column's value as canonical text: distinct values stay distinct (NaN is
    missing, -0.0 equals 0.0, nested values as JSON)."""
    dt = df.schema[name].dataType
    c = col_of(name)
    if is_floating(dt):
        c = F.nanvl(c, F.lit(None).cast(dt)) + F.lit(0.0).cast(dt)
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def value_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by..., column, distinct, value, freq)``: per column the number of
    distinct present values and the mode (smallest on ties), from ONE long-form
    pass: (column, value) counts, map-side combined, then per column a count and
    ``min(struct(-count, value))``. Scales with the number of columns linearly
    (Spark's multi-column exact distinct expands every row once per column with
    projections as wide as the table)."""
    cols, by = list(cols), list(by)
    require_columns(df, *cols, *by)
    if not cols:
        raise ValueError("value_summary needs at least one column")
    if len(cols) > 1:  # the unpivot multiplies rows: do it on all cores
        from ..session import spread
        df = spread(df.select(*map(col_of, [*by, *cols])))
    def order_key(c):  # ties go to the smallest value: numbers compare as numbers, the rest as text
        dt = df.schema[c].dataType
        return col_of(c).cast("double") if isinstance(dt, T.NumericType) else F.lit(None).cast("double")

    items = [F.struct(F.lit(i).alias("ci"), value_as_text(df, c).alias("value"), order_key(c).alias("num"))
             for i, c in enumerate(cols)]
    long = df.select(*map(col_of, by), F.inline(F.array(*items))).where(F.col("value").isNotNull())
    counts = long.groupBy(*map(col_of, by), "ci", "value").agg(F.count(F.lit(1)).alias("freq"), F.first("num").alias("num"))
    best = counts.groupBy(*map(col_of, by), "ci").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.min(F.struct((-F.col("freq")).alias("nf"), F.col("num").alias("num"),
                       F.col("value").alias("value"))).alias("m"))
    names = F.array(*[F.lit(c) for c in cols])
    return best.select(*map(col_of, by), F.element_at(names, F.col("ci") + 1).alias("column"), "distinct",
                       F.col("m.value").alias("value"), (-F.col("m.nf")).alias("freq"))


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by..., column, value, freq)``: the mode of each column as text.

    Missing values are not counted; a column with no value has no row.
    """
    return value_summary(df, cols, by).drop("distinct")
