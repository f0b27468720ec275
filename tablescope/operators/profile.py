"""Column profiling.

Per-column figures for all columns come from ONE wide aggregation turned into
long form with ``inline`` (one row per column), and exact distinct counts and
modes from ONE (column, value) pass, instead of one pass per column as the
reference does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (BOOLEAN, DATETIME, TEXT, col_of, NUMERIC, columns_of_class, missing_as_null, numeric_columns, require_columns,
                                 text_columns, type_class)
from ..functions.exprs import mean_of, pct, std_of
from ..functions.modes import value_summary
from ..functions.quantiles import quantile_values, quantiles


#: Columns whose exact moments one aggregation computes: more would not compile into one method.
MOMENT_COLUMNS = 4
#: Longer texts are compared by length and 128-bit digest, as a shuffle key of whole texts would carry them.
WHOLE_BYTES = 64


def _present(df: DataFrame, c: str) -> Column:
    return missing_as_null(df, c)


def _dtype(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def columns_by_type(df: DataFrame) -> DataFrame:
    """Schema listing ``(position, column, dtype, type_class)`` (F3/P3); metadata only."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), type_class(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, dtype string, type_class string")


def types(df: DataFrame) -> DataFrame:
    """The type of every column (same as ``columns_by_type``)."""
    return columns_by_type(df)


def column_counts(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, type_class, rows, non_null)`` for every column
    from ONE aggregation; overview, missing and completeness derive from it."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(_present(df, c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                      F.lit(_dtype(df, c)).alias("dtype"),
                      F.lit(type_class(df.schema[c].dataType)).alias("type_class"),
                      F.col("_rows").alias("rows"), F.col(f"_nn{i}").alias("non_null"))
             for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*items)))


def overview_of(counts: DataFrame) -> DataFrame:
    return counts.select("position", "column", "dtype", "type_class", "non_null",
                         (F.col("rows") - F.col("non_null")).alias("nulls"))


def missing_of(counts: DataFrame, digits: int = 2) -> DataFrame:
    gap = F.col("rows") - F.col("non_null")
    return (counts.select("position", "column", gap.alias("missing"),
                          pct(gap, F.col("rows"), digits).alias("missing_pct"))
            .where(F.col("missing") > 0))


def completeness_of(counts: DataFrame, digits: int = 2) -> DataFrame:
    row = counts.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).cast("int").alias("columns"),
                     F.sum("non_null").alias("non_null_cells"))
    cells = F.col("rows") * F.col("columns")
    return row.select("rows", "columns", cells.alias("cells"), "non_null_cells",
                      pct(F.col("non_null_cells"), cells, digits).alias("completeness_pct"))


def overview(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, type_class, non_null, nulls)`` per column, one pass."""
    return overview_of(column_counts(df))


def missing(df: DataFrame, digits: int = 2) -> DataFrame:
    """``(position, column, missing, missing_pct)`` for columns with at least one gap."""
    return missing_of(column_counts(df), digits)


def _groupable(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = col_of(f.name)
        if isinstance(f.dataType, T.MapType) or (
                isinstance(f.dataType, (T.ArrayType, T.StructType)) and "map<" in f.dataType.simpleString()):
            c = F.to_json(c)
        elif T.VariantType and isinstance(f.dataType, T.VariantType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return out


def _row_keys(df: DataFrame) -> list[Column]:
    """Narrow keys that are equal where rows are: a text or binary value of more than
    ``WHOLE_BYTES`` is known by its 128-bit digest and its length, so whole texts are not
    shuffled; every other value stands for itself."""
    out = []
    for i, (f, c) in enumerate(zip(df.schema.fields, _groupable(df))):
        plain = isinstance(f.dataType, T.BinaryType) or isinstance(f.dataType, T.StringType) and f.dataType == T.StringType()
        if not plain:  # numbers, times, nested values, and texts whose collation decides what is equal
            out.append(c.alias(f"_k{i}"))
            continue
        long = F.octet_length(col_of(f.name)) > WHOLE_BYTES
        out += [F.when(~long, col_of(f.name)).alias(f"_k{i}"), F.when(long, F.octet_length(col_of(f.name))).alias(f"_l{i}"),
                F.when(long, F.unhex(F.md5(col_of(f.name)))).alias(f"_d{i}")]
    return out


def duplicates(df: DataFrame, digits: int = 1) -> DataFrame:
    """``(rows, duplicate_rows, duplicate_pct)``; a duplicate is a row equal to an
    earlier one (NULL equals NULL, NaN equals NaN).

    One map-side-combined group-by over all columns: a row repeated a billion
    times costs one row per partition in the shuffle, and a long text its digest.
    """
    keyed = df.select(*_row_keys(df))
    groups = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("rows"), digits))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """P6 (numbers): ``(column, count, mean, std, min, p25, p50, p75, max)`` per numeric column.

    Moments of ``MOMENT_COLUMNS`` columns in one aggregation, which reads only these;
    quartiles from the exact quantiles (``approx=True``: ``percentile_approx``).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, count long, mean double, std double, min double, p25 double, "
                "p50 double, p75 double, max double")
    require_columns(df, *cols)
    parts = []
    for start in range(0, len(cols), MOMENT_COLUMNS):
        aggs, items = [], []
        for i, c in list(enumerate(cols))[start:start + MOMENT_COLUMNS]:
            v, dt = _present(df, c), df.schema[c].dataType
            aggs += [F.count(v).alias(f"n{i}"), mean_of(v, dt).alias(f"m{i}"), std_of(v, dt).alias(f"s{i}"),
                     F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}")]
            items.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                                  F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*items))))
    moments = reduce(DataFrame.unionByName, parts)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx)
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
                                   for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return (moments.join(F.broadcast(qw), "column", "left")
            .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def describe_text(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """P6 (text): ``(column, count, unique, top, freq)``; ``top`` is the most frequent
    value, the smallest on ties. Present counts in one aggregation; unique, top
    and freq from one (column, value) pass (``approx=True``: HLL distinct counts)."""
    cols = list(cols) if cols is not None else text_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count long, unique long, top string, freq long")
    require_columns(df, *cols)
    row = df.agg(*[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(cols)]
                 + ([F.approx_count_distinct(col_of(c)).alias(f"u{i}") for i, c in enumerate(cols)] if approx else []))
    items = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                      *([F.col(f"u{i}").alias("approx_unique")] if approx else []))
             for i, c in enumerate(cols)]
    counts = row.select(F.inline(F.array(*items)))
    vs = value_summary(df, cols).select("column", F.col("distinct").alias("unique"), F.col("value").alias("top"),
                                        "freq")
    out = counts.join(F.broadcast(vs), "column", "left")
    if approx:
        out = out.withColumn("unique", F.col("approx_unique"))
    return out.select("column", "count", F.coalesce(F.col("unique"), F.lit(0)).alias("unique"), "top", "freq")


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P6, every column: ``(position, column, type_class, count, unique, top, freq, min, max)``.

    ``top`` is the most frequent value, the smallest on ties, ``freq`` its rows; ``min``
    and ``max`` stand for columns with an order of size (numbers, dates, times; not
    texts or booleans). Values are texts as Spark casts them. Counts and bounds of
    ``MOMENT_COLUMNS`` columns in one aggregation; unique, top and freq of text,
    boolean and datetime columns from one (column, value) pass (NULL for numbers).
    A column of another kind (arrays, maps, binary) has its count only.
    """
    cols = list(cols) if cols is not None else df.columns
    require_columns(df, *cols)
    kinds = {c: type_class(df.schema[c].dataType) for c in cols}
    parts = []
    for start in range(0, len(cols), MOMENT_COLUMNS):
        aggs, items = [], []
        for i, c in list(enumerate(cols))[start:start + MOMENT_COLUMNS]:
            v, sized = _present(df, c), kinds[c] in (NUMERIC, DATETIME)
            none = F.lit(None).cast("string")
            aggs += [F.count(v).alias(f"n{i}"), *([F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}")] if sized else [])]
            items.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("type_class"), F.col(f"n{i}").alias("count"),
                                  (F.col(f"lo{i}") if sized else none).alias("min"), (F.col(f"hi{i}") if sized else none).alias("max")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*items))))
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, column string, type_class string, count long, unique long, top string, freq long, min string, max string")
    out, named = reduce(DataFrame.unionByName, parts), [c for c in cols if kinds[c] in (TEXT, BOOLEAN, DATETIME)]
    if named:
        vs = value_summary(df.select(*[col_of(c).cast("string").alias(c) for c in named]), named)
        out = out.join(F.broadcast(vs.select("column", F.col("distinct").alias("unique"), F.col("value").alias("top"), "freq")), "column", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"))
    unique = F.when(F.col("type_class").isin(TEXT, BOOLEAN, DATETIME), F.coalesce("unique", F.lit(0).cast("long")))
    return out.select("position", "column", "type_class", "count", unique.alias("unique"), "top", "freq", "min", "max")


def column_profile(df: DataFrame, col: str, approx: bool = False, digits: int = 1) -> DataFrame:
    """P5: one row ``(column, dtype, distinct, nulls, null_pct, rows, count, mean, std,
    min, p25, p50, p75, max)``; the describe figures are NULL for a non-numeric column.
    One aggregation pass; the quartiles (distributed exact quantiles) join it as literals."""
    require_columns(df, col)
    v, dt = _present(df, col), df.schema[col].dataType
    numeric = type_class(dt) == NUMERIC
    distinct = F.approx_count_distinct(v) if approx else F.count_distinct(v)
    aggs = [F.count(F.lit(1)).alias("rows"), F.count(v).alias("_nn"), distinct.alias("distinct")]
    none = F.lit(None).cast("double")
    if numeric:
        aggs += [mean_of(v, dt).alias("mean"), std_of(v, dt).alias("std"),
                 F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max")]
        q = quantile_values(df, col, [0.25, 0.5, 0.75], approx=approx)[col]
        quart = [F.lit(q[p]).cast("double").alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
        tail = [F.col("_nn").alias("count"), "mean", "std", "min", *quart, "max"]
    else:
        tail = [F.lit(None).cast("long").alias("count"), none.alias("mean"), none.alias("std"), none.alias("min"),
                none.alias("p25"), none.alias("p50"), none.alias("p75"), none.alias("max")]
    return df.agg(*aggs).select(
        F.lit(col).alias("column"), F.lit(_dtype(df, col)).alias("dtype"), "distinct",
        (F.col("rows") - F.col("_nn")).alias("nulls"),
        pct(F.col("rows") - F.col("_nn"), F.col("rows"), digits).alias("null_pct"), "rows", *tail)


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """P5: the ``n`` most frequent present values ``(col, count)``, ties by value."""
    require_columns(df, col)
    v = _present(df, col)
    return (df.select(v.alias(col)).where(col_of(col).isNotNull()).groupBy(col_of(col))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), col_of(col).asc()).limit(n))


def samples(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """P5: ``n`` present values. Row order is not defined in Spark, so the
    smallest values are returned (deterministic, SURVEY D21); a top-k, not a sort."""
    require_columns(df, col)
    v = _present(df, col)
    return df.select(v.alias(col)).where(col_of(col).isNotNull()).orderBy(col_of(col).asc()).limit(n)


def completeness(df: DataFrame, digits: int = 2) -> DataFrame:
    """P7 quality: ``(rows, columns, cells, non_null_cells, completeness_pct)``, one pass."""
    return completeness_of(column_counts(df), digits)


def schema_map(df: DataFrame, approx: bool = False, digits: int = 1, stat_digits: int = 2) -> DataFrame:
    """P7 per column: ``(position, column, dtype, type_class, distinct, missing, missing_pct,
    min, max, mean)``; min/max/mean only for numeric columns (rounded to ``stat_digits``).
    One aggregation for counts and moments, one (column, value) pass for the
    exact distinct counts (``approx=True``: HLL in the first aggregation)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        v, dt = _present(df, c), df.schema[c].dataType
        aggs += [F.count(v).alias(f"nn{i}")]
        if approx:
            aggs += [F.approx_count_distinct(v).alias(f"u{i}")]
        if type_class(dt) == NUMERIC:
            aggs += [F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}"),
                     mean_of(v, dt).alias(f"m{i}")]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(df.columns):
        dt = df.schema[c].dataType
        num = type_class(dt) == NUMERIC

        def stat(name, _i=i, _num=num):
            return F.round(F.col(f"{name}{_i}"), stat_digits) if _num else F.lit(None).cast("double")
        items.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(_dtype(df, c)).alias("dtype"),
            F.lit(type_class(dt)).alias("type_class"),
            (F.col(f"u{i}") if approx else F.lit(None).cast("long")).alias("distinct"),
            (F.col("_rows") - F.col(f"nn{i}")).alias("missing"),
            pct(F.col("_rows") - F.col(f"nn{i}"), F.col("_rows"), digits).alias("missing_pct"),
            stat("lo").alias("min"), stat("hi").alias("max"), stat("m").alias("mean")))
    out = row.select(F.inline(F.array(*items)))
    if approx:
        return out
    vs = value_summary(df, df.columns).select("column", F.col("distinct").alias("_u"))
    return (out.join(F.broadcast(vs), "column", "left")
            .withColumn("distinct", F.coalesce(F.col("_u"), F.lit(0).cast("long")))
            .select("position", "column", "dtype", "type_class", "distinct", "missing", "missing_pct",
                    "min", "max", "mean"))


def schema_document(df: DataFrame, name: str | None = None, digits: int = 2) -> DataFrame:
    """The whole schema map as one row, ready for the JSON sink: ``dataset_name``,
    ``rows``, ``columns`` (names in order), ``dtypes`` and ``missing_counts`` (column -> type,
    column -> missing values), ``column_types`` (names by class), ``data_quality``
    (``duplicates``, ``completeness`` in percent, NULL for a table without cells) and
    ``generated_at``. One scan: rows are counted once per distinct row, and gaps are
    summed over the same groups."""
    keys, fields = _row_keys(df), df.schema.fields
    keyed = df.select(*keys, *[_present(df, f.name).isNotNull().alias(f"_p{i}") for i, f in enumerate(fields)])
    groups = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_n"))  # the flags follow from the keys
    row = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_dup"),
                     *[F.coalesce(F.sum(F.when(~F.col(f"_p{i}"), F.col("_n"))), F.lit(0)).alias(f"_m{i}") for i in range(len(fields))])
    cells, gaps = F.col("_rows") * len(fields), reduce(Column.__add__, [F.col(f"_m{i}") for i in range(len(fields))], F.lit(0).cast("long"))

    def texts(values) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")
    classes = F.struct(*[texts([f.name for f in fields if type_class(f.dataType) == k]).alias(k) for k in (NUMERIC, TEXT, DATETIME, BOOLEAN)])
    return row.select(
        F.lit(name).cast("string").alias("dataset_name"), F.col("_rows").alias("rows"), texts(df.columns).alias("columns"),
        F.map_from_arrays(texts(df.columns), texts([f.dataType.simpleString() for f in fields])).alias("dtypes"),
        F.map_from_arrays(texts(df.columns), F.array(*[F.col(f"_m{i}") for i in range(len(fields))]).cast("array<long>")).alias("missing_counts"),
        classes.alias("column_types"),
        F.struct(F.col("_dup").alias("duplicates"), pct(cells - gaps, cells, digits).alias("completeness")).alias("data_quality"),
        F.current_timestamp().alias("generated_at"))


def columns_in_class(df: DataFrame, klass: str) -> list[str]:
    """Names of the columns of a type class (numeric, text, datetime, boolean)."""
    return columns_of_class(df, klass)


__all__ = ["columns_by_type", "types", "column_counts", "overview", "overview_of", "missing", "missing_of",
           "completeness_of", "duplicates", "describe_numeric",
           "describe_text", "describe_all", "column_profile", "top_values", "samples", "completeness", "schema_map", "schema_document",
           "columns_in_class"]
