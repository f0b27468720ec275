"""Period trend analysis.

The base rows are touched by ONE map-side-combined aggregation into a
per-period table (one row per day / month / quarter / year, bounded by the
calendar, not by the data); every later figure (growth, peaks, direction) is a
window or aggregate over that small table. There is no sort of the base rows
(the reference sorts them first; grouping does not need it).

Departures from the reference, on purpose: dates are tried against an ordered
list of formats instead of the format of the first value (D13); a growth rate
from a zero period is NULL and left out of the mean (D19); figures are rounded
half-up (D12). ``totals`` functions take the output of ``period_totals`` and
work on its rounded sums, as the reference does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (col_of, DATETIME, NUMERIC, is_floating, missing_as_null, require_columns,
                                 type_class)
from ..functions.exprs import CODE_PATTERN, mean_of, pct, safe_div, std_of

FREQS = ("D", "M", "Q", "Y")

# The date formats tried, in order, after Spark's ISO cast.
# Slashed dates are month-first unless more of the column reads day-first.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd",
                "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss",
                "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "d-MMMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy")

# Direction classes and their strict limits (percent).
STRONG_UP, MODERATE_UP = "Strong Upward Trend", "Moderate Upward Trend"
STRONG_DOWN, MODERATE_DOWN = "Strong Downward Trend", "Moderate Downward Trend"
FLAT = "Stable/Flat Trend"
ACCELERATING, DECLINING, STABLE = "Accelerating", "Declining", "Stable"
COMPLETENESS_WARNING_PCT = 90.0


def day_first(df: DataFrame, col: str) -> bool:
    """Whether more values of the whole column read as dd/MM/yyyy than as MM/dd/yyyy
    (one aggregation; equal counts stay month-first)."""
    date = F.substring_index(F.trim(col_of(col).cast("string")), " ", 1)
    n = df.agg(*[F.count(F.try_to_timestamp(date, F.lit(f))).alias(k) for k, f in (("m", "MM/dd/yyyy"), ("d", "dd/MM/yyyy"))]).first()
    return n.d > n.m


def parse_dates(df: DataFrame, col: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The column as a timestamp; text that matches no format gives NULL. With the
    default formats, one order of day and month holds for all slashed dates of a text column."""
    require_columns(df, col)
    dt = df.schema[col].dataType
    c = col_of(col)
    if type_class(dt) == DATETIME:
        return c
    s = c.cast("string")
    if formats is DATE_FORMATS and isinstance(dt, T.StringType) and day_first(df, col):
        formats = [f.replace("MM/dd/yyyy", "dd/MM/yyyy") for f in formats]
    tries = [col_of(col).cast("string").try_cast("timestamp")]
    tries += [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def parse_numbers(df: DataFrame, col: str, to: str = "double") -> Column:
    """The column as a number (``to``: a Spark numeric type); unparsable text and NaN give NULL."""
    require_columns(df, col)
    dt = df.schema[col].dataType
    if type_class(dt) == NUMERIC:
        return missing_as_null(df, col)
    v = F.when(~col_of(col).cast("string").rlike(CODE_PATTERN), col_of(col).try_cast(to))
    if to in ("double", "float"):
        v = F.nanvl(v, F.lit(None).cast(to))
    return v


def coerce_dates(df: DataFrame, col: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Parse ``col`` to a timestamp and drop rows where it is missing or unparsable."""
    return df.withColumn(col, parse_dates(df, col, formats)).where(col_of(col).isNotNull())


def coerce_numbers(df: DataFrame, col: str, to: str = "double") -> DataFrame:
    """Parse ``col`` to a number and drop rows where it is missing or unparsable."""
    return df.withColumn(col, parse_numbers(df, col, to)).where(col_of(col).isNotNull())


def valid_rows(df: DataFrame, date_col: str, value_col: str, formats: Sequence[str] = DATE_FORMATS,
               to: str = "double") -> DataFrame:
    """F1+T1+T2: the two columns, parsed, rows with a valid date and value only."""
    require_columns(df, date_col, value_col)
    d = df.select(parse_dates(df, date_col, formats).alias(date_col),
                  parse_numbers(df, value_col, to).alias(value_col))
    return d.where(col_of(date_col).isNotNull() & col_of(value_col).isNotNull())


def period_label(ts: Column, freq: str) -> Column:
    """``2023-01-02`` (D), ``2023-01`` (M), ``2023Q1`` (Q), ``2023`` (Y).

    Built from calendar fields, which Spark reads from dates and zone-less
    timestamps without any time-zone conversion."""
    if freq == "D":
        return F.format_string("%04d-%02d-%02d", F.year(ts), F.month(ts), F.dayofmonth(ts))
    if freq == "M":
        return F.format_string("%04d-%02d", F.year(ts), F.month(ts))
    if freq == "Q":
        return F.format_string("%04dQ%d", F.year(ts), F.quarter(ts))
    if freq == "Y":
        return F.format_string("%04d", F.year(ts))
    raise ValueError(f"invalid frequency '{freq}'; use one of {list(FREQS)}")


def period_table(df: DataFrame, date_col: str, value_col: str, freq: str = "M",
                 formats: Sequence[str] = DATE_FORMATS, to: str = "double") -> DataFrame:
    """The one aggregation every trend figure can come from: per period label
    ``(period, sum, mean, n, rows, first_ts, last_ts)``; rows whose date or value
    is missing or unparsable land in the NULL period (map-side combined, so
    they cost one row per partition). Bounded by the calendar, not the data."""
    if freq not in FREQS:
        raise ValueError(f"invalid frequency '{freq}'; use one of {list(FREQS)}")
    require_columns(df, date_col, value_col)
    ts = parse_dates(df, date_col, formats)
    x = parse_numbers(df, value_col, to)
    ok = ts.isNotNull() & x.isNotNull()
    d = df.select(F.when(ok, period_label(ts, freq)).alias("period"), F.when(ok, ts).alias("_ts"),
                  F.when(ok, x).alias("_x"))
    dt = d.schema["_x"].dataType
    return d.groupBy("period").agg(
        F.sum("_x").alias("sum"), mean_of(F.col("_x"), dt).alias("mean"), F.count("_x").alias("n"),
        F.count(F.lit(1)).alias("rows"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"))


def _totals_of(table: DataFrame, digits: int = 2) -> DataFrame:
    return table.where(F.col("period").isNotNull()).select(
        "period", F.round("sum", digits).alias("sum"), F.round("mean", digits).alias("mean"),
        F.col("n").alias("count"))


def _range_of(table: DataFrame) -> DataFrame:
    return table.where(F.col("period").isNotNull()).agg(
        period_label(F.min("first_ts"), "D").alias("date_from"),
        period_label(F.max("last_ts"), "D").alias("date_to"),
        F.count(F.lit(1)).alias("periods"))


def _quality_of(table: DataFrame, digits: int = 1) -> DataFrame:
    row = table.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("valid_rows"))
    c = pct(F.col("valid_rows"), F.col("total_rows"))
    return row.select("total_rows", "valid_rows", F.round(c, digits).alias("completeness_pct"),
                      (c < F.lit(COMPLETENESS_WARNING_PCT)).alias("low_completeness"))


def period_totals(df: DataFrame, date_col: str, value_col: str, freq: str = "M", digits: int = 2,
                  formats: Sequence[str] = DATE_FORMATS, to: str = "double") -> DataFrame:
    """T4: ``(period, sum, mean, count)`` per period, sum and mean rounded to ``digits``."""
    if freq not in FREQS:
        raise ValueError(f"invalid frequency '{freq}'; use one of {list(FREQS)}")
    v = valid_rows(df, date_col, value_col, formats, to)
    dt = v.schema[value_col].dataType
    x = col_of(value_col)
    return (v.groupBy(period_label(col_of(date_col), freq).alias("period"))
            .agg(F.round(F.sum(x), digits).alias("sum"), F.round(mean_of(x, dt), digits).alias("mean"),
                 F.count(x).alias("count")))


def trend_range(df: DataFrame, date_col: str, value_col: str, freq: str = "M",
                formats: Sequence[str] = DATE_FORMATS, to: str = "double") -> DataFrame:
    """T5: ``(date_from, date_to, periods)`` over the valid rows, one pass."""
    period_label(F.lit(None), freq)
    v = valid_rows(df, date_col, value_col, formats, to)
    ts = col_of(date_col)
    return v.agg(period_label(F.min(ts), "D").alias("date_from"),
                 period_label(F.max(ts), "D").alias("date_to"),
                 F.count_distinct(period_label(ts, freq)).alias("periods"))


def recent_periods(totals: DataFrame, n: int = 20) -> DataFrame:
    """The latest ``n`` periods (a top-k on the period table)."""
    return totals.orderBy(F.col("period").desc()).limit(n).orderBy("period")


def _sum_type(totals: DataFrame) -> T.DataType:
    return totals.schema["sum"].dataType


def trend_summary(totals: DataFrame, digits: int = 2, cv_digits: int = 1) -> DataFrame:
    """``(periods, total, mean, std, cv_pct)`` over the period sums."""
    dt = _sum_type(totals)
    s = F.col("sum")
    row = totals.agg(F.count(s).alias("periods"), F.sum(s).alias("total"),
                     mean_of(s, dt).alias("_m"), std_of(s, dt).alias("_s"))
    return row.select("periods", F.col("total").cast("double").alias("total"),
                      F.round("_m", digits).alias("mean"), F.round("_s", digits).alias("std"),
                      pct(F.col("_s"), F.col("_m"), cv_digits).alias("cv_pct"))


def _growth_expr(cur: Column, prev: Column, exact: bool) -> Column:
    if exact:
        return safe_div((cur - prev).cast("double"), prev.cast("double")) * F.lit(100.0)
    return safe_div(cur - prev, prev) * F.lit(100.0)


def _ordered(totals: DataFrame) -> DataFrame:
    """The period table with its previous sum, position and size (single small window)."""
    w = Window.orderBy("period")
    exact = not is_floating(_sum_type(totals))
    return (totals.withColumn("prev_sum", F.lag("sum").over(w))
            .withColumn("_ord", F.row_number().over(w))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
            .withColumn("_g", _growth_expr(F.col("sum"), F.col("prev_sum"), exact)))


def growth(totals: DataFrame, digits: int = 2, min_periods: int = 3) -> DataFrame:
    """``(period, sum, prev_sum, growth_pct)`` period over period; empty when fewer
    than ``min_periods`` periods."""
    o = _ordered(totals)
    return o.where(F.col("_n") >= min_periods).select(
        "period", "sum", "prev_sum", F.round("_g", digits).alias("growth_pct"))


def _classify(g: Column, strong: float = 10.0, moderate: float = 2.0) -> Column:
    return (F.when(g > strong, STRONG_UP).when(g > moderate, MODERATE_UP)
            .when(g < -strong, STRONG_DOWN).when(g < -moderate, MODERATE_DOWN).otherwise(FLAT))


def direction(totals: DataFrame, digits: int = 2, min_periods: int = 3) -> DataFrame:
    """T8+T9: ``(periods, first_sum, last_sum, avg_growth_pct, overall_growth_pct, direction)``.

    Overall growth from the first to the last period; from a zero first period
    it is NULL and the class follows the sign of the change (the reference's inf).
    """
    o = _ordered(totals)
    exact = not is_floating(_sum_type(totals))
    row = o.agg(F.count(F.lit(1)).alias("periods"),
                F.min_by("sum", "_ord").alias("first_sum"), F.max_by("sum", "_ord").alias("last_sum"),
                F.avg("_g").alias("_avg"))
    overall = _growth_expr(F.col("last_sum"), F.col("first_sum"), exact)
    change = F.col("last_sum") - F.col("first_sum")
    cls = F.when(F.col("first_sum") == 0,
                 F.when(change > 0, STRONG_UP).when(change < 0, STRONG_DOWN).otherwise(FLAT)) \
        .otherwise(_classify(overall))
    return row.where(F.col("periods") >= min_periods).select(
        "periods", F.col("first_sum").cast("double").alias("first_sum"),
        F.col("last_sum").cast("double").alias("last_sum"),
        F.round("_avg", digits).alias("avg_growth_pct"), F.round(overall, digits).alias("overall_growth_pct"),
        cls.alias("direction"))


def peaks(totals: DataFrame, min_periods: int = 3) -> DataFrame:
    """``(highest_period, highest_sum, lowest_period, lowest_sum)``, the earliest
    period on ties (D11); empty when fewer than ``min_periods`` periods."""
    s = F.col("sum")
    row = totals.agg(F.count(F.lit(1)).alias("periods"),
                     F.min(F.struct((-s).alias("k"), F.col("period").alias("p"))).alias("hi"),
                     F.min(F.struct(s.alias("k"), F.col("period").alias("p"))).alias("lo"))
    return row.where(F.col("periods") >= min_periods).select(
        F.col("hi.p").alias("highest_period"), (-F.col("hi.k")).cast("double").alias("highest_sum"),
        F.col("lo.p").alias("lowest_period"), F.col("lo.k").cast("double").alias("lowest_sum"))


def recent_direction(totals: DataFrame, n: int = 6, digits: int = 2, limit: float = 5.0) -> DataFrame:
    """Change from the ``n``-th last to the last period: ``(first_period, last_period,
    change_pct, direction)`` with >limit Accelerating, <-limit Declining; empty below ``n`` periods.
    From a zero period ``change_pct`` is NULL and the sign of the last sum decides."""
    exact = not is_floating(_sum_type(totals))
    last = totals.orderBy(F.col("period").desc()).limit(n)
    row = last.agg(F.count(F.lit(1)).alias("k"),
                   F.min_by(F.struct("period", "sum"), "period").alias("a"),
                   F.max_by(F.struct("period", "sum"), "period").alias("b"))
    change = _growth_expr(F.col("b.sum"), F.col("a.sum"), exact)
    zero = F.col("a.sum") == 0
    cls = (F.when((change > limit) | (zero & (F.col("b.sum") > 0)), ACCELERATING)
           .when((change < -limit) | (zero & (F.col("b.sum") < 0)), DECLINING).otherwise(STABLE))
    return row.where(F.col("k") >= n).select(
        F.col("a.period").alias("first_period"), F.col("b.period").alias("last_period"),
        F.round(change, digits).alias("change_pct"), cls.alias("direction"))


def trend_quality(df: DataFrame, date_col: str, value_col: str, formats: Sequence[str] = DATE_FORMATS,
                  to: str = "double", digits: int = 1) -> DataFrame:
    """``(total_rows, valid_rows, completeness_pct, low_completeness)``, one pass."""
    require_columns(df, date_col, value_col)
    ok = parse_dates(df, date_col, formats).isNotNull() & parse_numbers(df, value_col, to).isNotNull()
    row = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("valid_rows"))
    c = pct(F.col("valid_rows"), F.col("total_rows"))
    return row.select("total_rows", "valid_rows", F.round(c, digits).alias("completeness_pct"),
                      (c < F.lit(COMPLETENESS_WARNING_PCT)).alias("low_completeness"))


def _fmt(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def trend_report(df: DataFrame, date_col: str, value_col: str, freq: str = "M",
                 formats: Sequence[str] = DATE_FORMATS, to: str = "double", recent: int = 20) -> DataFrame:
    """Every finding above as long-form rows ``(section, metric, value)``.

    The source is scanned once into the per-period table (``period_table``,
    bounded by the calendar), which is checkpointed; every branch reads it.
    """
    from ..session import materialize
    # one scan of the source into the small per-period table, pinned in the
    # checkpoint folder; every branch below reads it
    table = materialize(period_table(df, date_col, value_col, freq, formats, to))
    totals = _totals_of(table)
    parts = []

    def add(frame, section, pairs):
        parts.append(frame.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), v.cast("string").alias("value"))
            for m, v in pairs]))))

    r = _range_of(table)
    add(r, "range", [("date_from", F.col("date_from")), ("date_to", F.col("date_to")),
                     ("periods", F.col("periods"))])
    rec = recent_periods(totals, recent)
    parts.append(rec.select(F.lit("recent_periods").alias("section"), F.col("period").alias("metric"),
                            F.concat_ws(" | ", _fmt(F.col("sum")), _fmt(F.col("mean")),
                                        F.col("count").cast("string")).alias("value")))
    s = trend_summary(totals)
    add(s, "summary", [("total", _fmt(F.col("total"))), ("mean_per_period", _fmt(F.col("mean"))),
                       ("std", _fmt(F.col("std"))), ("cv_pct", _fmt(F.col("cv_pct"), 1))])
    dr = direction(totals)
    add(dr, "growth", [("avg_growth_pct", _fmt(F.col("avg_growth_pct"))),
                       ("overall_growth_pct", _fmt(F.col("overall_growth_pct"))),
                       ("direction", F.col("direction"))])
    pk = peaks(totals)
    add(pk, "peaks", [("highest_period", F.col("highest_period")), ("highest_sum", _fmt(F.col("highest_sum"))),
                      ("lowest_period", F.col("lowest_period")), ("lowest_sum", _fmt(F.col("lowest_sum")))])
    rd = recent_direction(totals)
    add(rd, "recent", [("change_pct", _fmt(F.col("change_pct"))), ("direction", F.col("direction"))])
    q = _quality_of(table)
    add(q, "quality", [("total_rows", F.col("total_rows")), ("valid_rows", F.col("valid_rows")),
                       ("completeness_pct", _fmt(F.col("completeness_pct"), 1)),
                       ("low_completeness", F.col("low_completeness"))])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
