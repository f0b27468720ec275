"""Trend analysis and chart data on edge fixtures."""

import datetime as dt

import numpy as np
import pytest

from tablescope.operators import chartdata, trend
from tests.conftest import rows


def _monthly(spark, sums):
    data = [(dt.date(2023, 1, 1) + dt.timedelta(days=31 * i), float(s)) for i, s in enumerate(sums)]
    return spark.createDataFrame(data, "d date, v double")


def test_dates_mixed_and_numbers(spark):
    df = spark.createDataFrame([("2023-01-02", "1.5"), ("05/03/2023", " 2 "), ("bad", "3"),
                                ("2023-02-01", "1.5x"), ("2023-02-02", "NaN"), (None, "1")], "d string, v string")
    v = trend.valid_rows(df, "d", "v")
    got = sorted((r["d"].strftime("%Y-%m-%d"), r["v"]) for r in v.collect())
    assert got == [("2023-01-02", 1.5), ("2023-05-03", 2.0)]
    q = trend.trend_quality(df, "d", "v").first()
    assert (q["total_rows"], q["valid_rows"], q["completeness_pct"], q["low_completeness"]) == (6, 2, 33.3, True)


def test_period_labels(spark):
    df = spark.createDataFrame([(dt.date(2023, 5, 17), 1.0)], "d date, v double")
    labels = {f: trend.period_totals(df, "d", "v", f).first()["period"] for f in trend.FREQS}
    assert labels == {"D": "2023-05-17", "M": "2023-05", "Q": "2023Q2", "Y": "2023"}
    with pytest.raises(ValueError):
        trend.period_totals(df, "d", "v", "W")


@pytest.mark.parametrize("n,growth_rows,recent_rows", [(1, 0, 0), (2, 0, 0), (3, 3, 0), (5, 5, 0), (6, 6, 1)])
def test_limits_at_3_and_6_periods(spark, n, growth_rows, recent_rows):
    t = trend.period_totals(_monthly(spark, range(1, n + 1)), "d", "v")
    assert trend.growth(t).count() == growth_rows
    assert trend.direction(t).count() == (1 if n >= 3 else 0)
    assert trend.recent_direction(t).count() == recent_rows


def test_zero_first_period_growth_null(spark):
    t = trend.period_totals(_monthly(spark, [0, 5, 10]), "d", "v")
    g = {r["period"]: r["growth_pct"] for r in trend.growth(t).collect()}
    assert g["2023-02"] is None and g["2023-03"] == 100.0
    r = trend.direction(t).first()
    assert r["overall_growth_pct"] is None and r["direction"] == trend.STRONG_UP
    assert r["avg_growth_pct"] == 100.0


@pytest.mark.parametrize("last,cls", [(110, trend.MODERATE_UP), (110.01, trend.STRONG_UP), (102, trend.FLAT),
                                      (102.5, trend.MODERATE_UP), (98, trend.FLAT), (90, trend.MODERATE_DOWN),
                                      (89, trend.STRONG_DOWN)])
def test_direction_limits_are_strict(spark, last, cls):
    t = trend.period_totals(_monthly(spark, [100, 100, last]), "d", "v")
    assert trend.direction(t).first()["direction"] == cls


@pytest.mark.parametrize("last,cls", [(105, trend.STABLE), (105.5, trend.ACCELERATING), (95, trend.STABLE),
                                      (94, trend.DECLINING)])
def test_recent_direction_limits(spark, last, cls):
    t = trend.period_totals(_monthly(spark, [1, 100, 7, 7, 7, 7, last]), "d", "v")
    r = trend.recent_direction(t).first()
    assert r["direction"] == cls and r["first_period"] == "2023-02"


def test_gap_month_not_filled_and_peaks_earliest(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 5), 5.0), (dt.date(2023, 3, 5), 5.0), (dt.date(2023, 4, 5), 1.0)],
                               "d date, v double")
    t = trend.period_totals(df, "d", "v")
    assert [r["period"] for r in t.orderBy("period").collect()] == ["2023-01", "2023-03", "2023-04"]
    p = trend.peaks(t).first()
    assert (p["highest_period"], p["lowest_period"]) == ("2023-01", "2023-04")


def test_period_counts_sum_to_valid_rows(spark):
    df = _monthly(spark, range(40))
    t = trend.period_totals(df, "d", "v", "Q")
    assert sum(r["count"] for r in t.collect()) == 40


def test_report_has_sections(spark):
    r = trend.trend_report(_monthly(spark, range(1, 8)), "d", "v")
    assert {x["section"] for x in r.collect()} == {"range", "recent_periods", "summary", "growth", "peaks",
                                                   "recent", "quality"}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(10, 3, 2000), 2)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    h = chartdata.histogram(df, "x", 30).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=30)
    assert [r["count"] for r in h] == counts.tolist()
    assert [r["bin_low"] for r in h] == pytest.approx(edges[:-1].tolist())


def test_histogram_constant(spark):
    df = spark.createDataFrame([(4.0,)] * 5, "x double")
    h = chartdata.histogram(df, "x", 30).orderBy("bin").collect()
    counts, _ = np.histogram([4.0] * 5, bins=30)
    assert [r["count"] for r in h] == counts.tolist()


def test_box_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = chartdata.box(df, "x").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert (r["q1"], r["q3"]) == (q1, q3)
    assert r["whisker_high"] == 5.0 and r["whisker_low"] == 1.0 and r["n_outliers"] == 1


def test_box_grouped_and_bar_pie(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, v double")
    b = {r["g"]: r for r in chartdata.box(df, "g", "v").collect()}
    assert set(b) == {"a", "b"} and b["a"]["median"] == 2.0
    assert rows(chartdata.bar(df, "g")) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(chartdata.bar(df, "g", "v")) == [("a", 4.0), ("b", 4.0)]
    shares = rows(chartdata.pie(df, "g", 2), "g", "share_pct")
    assert shares == [("a", 50.0), ("b", 50.0)]


def test_line_parses_text_dates(spark):
    df = spark.createDataFrame([("2023-01-01", 1.0), ("2023-01-01", 3.0), ("01/02/2023", 2.0)], "x string, y double")
    out = chartdata.line(df, "x", "y").collect()
    assert len(out) == 2 and out[0]["x"] is not None
    kept = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "x string, y double")
    assert {r["x"] for r in chartdata.line(kept, "x", "y").collect()} == {"a", "b"}


def test_scatter_requires_numeric(spark):
    df = spark.createDataFrame([("a", 1.0)], "x string, y double")
    with pytest.raises(ValueError):
        chartdata.scatter(df, "x", "y")


def test_histogram_counts_sum_to_present_rows(spark):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)] + [(None,), (float("nan"),)], "x double")
    assert sum(r["count"] for r in chartdata.histogram(df, "x", 7).collect()) == 500


def test_one_order_of_day_and_month_per_column(spark):
    def days(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "d string")
        return sorted(r.d.strftime("%m-%d") for r in trend.coerce_dates(df, "d").collect())
    assert days("25/01/2023", "03/02/2023", "14/02/2023", "01/03/2023") == ["01-25", "02-03", "02-14", "03-01"]
    assert days("01/25/2023", "03/02/2023") == ["01-25", "03-02"]


def test_integer_dates_and_text_codes(spark):
    r = trend.coerce_dates(spark.createDataFrame([(20230115,)], "d long"), "d").first()
    assert r.d.strftime("%Y-%m-%d") == "2023-01-15"
    df = spark.createDataFrame([("1D",), ("2F",), ("3.5",), ("1e3",)], "v string")
    assert sorted(r.v for r in trend.coerce_numbers(df, "v").collect()) == [3.5, 1000.0]


def test_recent_direction_from_a_zero_period(spark):
    t = trend.period_totals(_monthly(spark, [0, 1, 2, 3, 4, 50]), "d", "v")
    assert trend.recent_direction(t).first().direction == trend.ACCELERATING
