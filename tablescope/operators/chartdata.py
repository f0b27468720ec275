"""The aggregated data behind bar, line, pie, scatter, histogram and box charts
(SURVEY V1-V7). Drawing is not done: the part that must scale is the data.

Every chart first drops rows missing in x (and y), as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of, TEXT, missing_as_null, require_columns, require_numeric, type_class
from ..functions.exprs import mean_of, pct, std_of
from ..functions.quantiles import quantiles
from .trend import parse_dates

CI_Z = 1.96  # normal quantile of a 95 % band


def _present(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    cols = [x] + ([y] if y else [])
    require_columns(df, *cols)
    d = df.select(*[missing_as_null(df, c).alias(c) for c in cols])
    cond = col_of(x).isNotNull()
    if y:
        cond = cond & col_of(y).isNotNull()
    return d.where(cond)


def _largest(d: DataFrame, x: str, name: str, agg: Column, n: int, rows_used: bool) -> DataFrame:
    """The ``n`` groups of the largest ``agg``, ties by x. With ``rows_used``, the rows of
    all groups beside each: groups and total come from one ROLLUP, one read of the rows."""
    if not rows_used:
        return d.groupBy(col_of(x)).agg(agg.alias(name)).orderBy(F.col(name).desc(), col_of(x).asc()).limit(n)
    both = d.rollup(col_of(x)).agg(agg.alias(name), F.count(F.lit(1)).alias("_rows"), F.grouping_id().alias("_level"))
    top = both.orderBy(F.col("_level").desc(), F.col(name).desc(), col_of(x).asc()).limit(n + 1)  # the total comes first
    every = Window.partitionBy(F.lit(1))  # over at most n + 1 rows
    return (top.withColumn("rows_used", F.max(F.when(F.col("_level") == 1, F.col("_rows"))).over(every)).where("_level = 0")
            .orderBy(F.col(name).desc(), col_of(x).asc()).select(col_of(x), name, "rows_used"))


def bar(df: DataFrame, x: str, y: str | None = None, n: int | None = None, rows_used: bool = False) -> DataFrame:
    """V1/V2: without ``y`` the ``n`` (20) most frequent x ``(x, count)``; with a
    numeric ``y`` the ``n`` (15) largest sums ``(x, sum)``. Ties by x. ``rows_used``
    adds how many rows the chart is made of, shown or not."""
    d = _present(df, x, y)
    if not y:
        return _largest(d, x, "count", F.count(F.lit(1)), n or 20, rows_used)
    require_numeric(df, y)
    return _largest(d, x, "sum", F.sum(col_of(y)), n or 15, rows_used)


def pie(df: DataFrame, x: str, n: int = 10, digits: int = 1, rows_used: bool = False) -> DataFrame:
    """V4: the ``n`` most frequent values and their share of the ``n`` shown
    ``(x, count, share_pct)`` (the reference's pie labels); ``rows_used`` as in ``bar``."""
    top = _largest(_present(df, x), x, "count", F.count(F.lit(1)), n, rows_used)
    shown = F.sum("count").over(Window.partitionBy(F.lit(1)))  # over at most n rows
    return top.select(col_of(x), "count", pct(F.col("count"), shown, digits).alias("share_pct"), *(["rows_used"] if rows_used else []))


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """V3: mean of y per x with a 95 % band ``(x, mean, std, count, ci_low, ci_high)``.

    Text x is read as dates when every present value parses (one counting
    pass), else kept as is. The band is mean +- 1.96 sd / sqrt(n), a normal
    approximation (the reference's plotting library bootstraps; not deterministic).
    """
    require_numeric(df, y)
    d = _present(df, x, y)
    if type_class(d.schema[x].dataType) == TEXT:
        parsed = parse_dates(d, x)
        r = d.agg(F.count(col_of(x)).alias("a"), F.count(parsed).alias("b")).first()
        if r["a"] > 0 and r["a"] == r["b"]:
            d = d.withColumn(x, parsed)
    dt = d.schema[y].dataType
    v = col_of(y)
    g = d.groupBy(col_of(x)).agg(mean_of(v, dt).alias("mean"), std_of(v, dt).alias("std"), F.count(v).alias("count"))
    half = F.lit(CI_Z) * F.col("std") / F.sqrt(F.col("count").cast("double"))
    return g.select(col_of(x), "mean", "std", "count", (F.col("mean") - half).alias("ci_low"),
                    (F.col("mean") + half).alias("ci_high"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """V5: every (x, y) point where both are present; both must be numeric. All
    points are returned (no sampling); write them out rather than collect them."""
    require_numeric(df, x)
    require_numeric(df, y)
    return _present(df, x, y)


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """V6: ``bins`` equal-width bins between min and max ``(bin, bin_low, bin_high, count)``.

    Same binning rule as numpy's histogram: the last bin is closed, a constant
    column gets the range (v - 0.5, v + 0.5), and a value on an edge goes to the
    bin that edge opens. Empty bins are listed with count 0. One pass for the
    range (two scalars to the driver), one aggregation into ``bins`` rows.
    """
    require_numeric(df, x)
    d = _present(df, x)
    r = d.agg(F.min(col_of(x).cast("double")).alias("lo"), F.max(col_of(x).cast("double")).alias("hi")).first()
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_low double, bin_high double, count long")
    lo, hi = float(r["lo"]), float(r["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    norm = bins / (hi - lo)

    def edge(i):
        return F.when(i >= F.lit(bins), F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    v = col_of(x).cast("double")
    i0 = F.floor((v - F.lit(lo)) * F.lit(norm)).cast("int")
    i0 = F.when(i0 == F.lit(bins), F.lit(bins - 1)).otherwise(i0)
    i1 = F.when(v < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((v >= edge(i1 + 1)) & (i1 != F.lit(bins - 1)), i1 + 1).otherwise(i1)
    counts = d.select((i2 + 1).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    frame = frame.select("bin", edge(F.col("bin") - 1).alias("bin_low"), edge(F.col("bin")).alias("bin_high"))
    return (frame.join(F.broadcast(counts), "bin", "left")
            .select("bin", "bin_low", "bin_high", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def box(df: DataFrame, x: str, y: str | None = None, whis: float = 1.5) -> DataFrame:
    """V7: box-plot statistics of numeric ``x`` or, with ``y``, of numeric ``y`` per
    group of ``x``: ``([x,] count, q1, median, q3, iqr, lower_fence, upper_fence,
    whisker_low, whisker_high, n_outliers)``. Whiskers reach the furthest value
    inside ``whis`` * IQR; outliers lie beyond them (no value lies between a
    fence and its whisker, so outliers are the values outside the fences).

    Quartiles come from the distributed exact quantiles (a hot group is spread
    over many tasks); the fences table (one row per group) is joined back by
    group: AQE broadcasts it when its measured size is small, else the join
    is shuffled and AQE splits a skewed group.
    Then one aggregation gives whiskers and outlier counts.
    """
    if y:
        require_numeric(df, y)
        d = _present(df, x, y)
        value, by = y, [x]
    else:
        require_numeric(df, x)
        d = _present(df, x)
        value, by = x, []
    q = quantiles(d, [value], [0.25, 0.5, 0.75], by=by)
    fences = q.groupBy(*map(col_of, by)).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(nm)
                                  for p, nm in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    fences = (fences.withColumn("iqr", F.col("q3") - F.col("q1"))
              .withColumn("lower_fence", F.col("q1") - F.lit(whis) * F.col("iqr"))
              .withColumn("upper_fence", F.col("q3") + F.lit(whis) * F.col("iqr")))
    if by:
        # one row per group: AQE broadcasts it when its measured size is small
        joined = d.join(fences, by)
    else:
        f = fences.first()  # one row of scalars; applied as literals, no join
        joined = d.select(col_of(value), *[F.lit(f[c] if f else None).cast("double").alias(c)
                                          for c in ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence")])
    v = col_of(value).cast("double")
    outside = (v < F.col("lower_fence")) | (v > F.col("upper_fence"))
    keep = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    out = joined.groupBy(*map(col_of, by)).agg(
        F.count(v).alias("count"), *[F.first(c).alias(c) for c in keep],
        F.min(F.when(v >= F.col("lower_fence"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("upper_fence"), v)).alias("whisker_high"),
        F.count_if(outside).alias("n_outliers"))
    return out.select(*map(col_of, by), "count", *keep, "whisker_low", "whisker_high", "n_outliers")


__all__ = ["bar", "pie", "line", "scatter", "histogram", "box"]
