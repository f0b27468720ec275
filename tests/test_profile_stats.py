"""Profiling and statistics on hand-made edge fixtures (FIXTURES.md section 3)."""

import math

import pytest

from tablescope.operators import profile, stats
from tests.conftest import rows

PEOPLE = [
    (1, "  Ann ", 30.0, "Oslo"),
    (2, "Ann", float("nan"), None),
    (3, None, 41.0, "\tBergen\n"),
    (4, "Bob", None, "Oslo"),
    (4, "Bob", None, "Oslo"),          # full-row duplicate
    (5, "Cy", 25.0, "Oslo "),
    (6, "Cy", 25.0, "Oslo"),
]


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, age double, city string")


def test_overview_counts_nan_as_missing(people):
    got = {r["column"]: (r["non_null"], r["nulls"], r["type_class"]) for r in profile.overview(people).collect()}
    assert got["age"] == (4, 3, "numeric")
    assert got["name"] == (6, 1, "text")
    assert got["id"] == (7, 0, "numeric")


def test_missing_only_gapped_columns(people):
    got = {r["column"]: (r["missing"], r["missing_pct"]) for r in profile.missing(people).collect()}
    assert set(got) == {"name", "age", "city"}
    assert got["age"] == (3, round(300 / 7, 2))


def test_duplicates(people):
    r = profile.duplicates(people).first()
    assert (r["rows"], r["duplicate_rows"]) == (7, 1)
    assert r["duplicate_pct"] == 14.3


def test_duplicates_nan_equal(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("nan"), None)], "x double, s string")
    assert profile.duplicates(df).first()["duplicate_rows"] == 1


def test_describe_numeric_and_text(people):
    d = {r["column"]: r for r in profile.describe_numeric(people).collect()}
    assert d["age"]["count"] == 4
    assert d["age"]["p50"] == pytest.approx(27.5)
    assert d["id"]["mean"] == pytest.approx(25 / 7)
    t = {r["column"]: r for r in profile.describe_text(people).collect()}
    assert t["name"]["top"] == "Bob" and t["name"]["freq"] == 2
    assert t["city"]["unique"] == 3


def test_column_profile_text_has_null_describe(people):
    r = profile.column_profile(people, "city").first()
    assert r["distinct"] == 3 and r["nulls"] == 1 and r["mean"] is None


def test_samples_and_top_values(people):
    assert rows(profile.samples(people, "age", 2), "age") == [(25.0,), (25.0,)]
    assert rows(profile.top_values(people, "city", 1)) == [("Oslo", 4)]


def test_completeness_and_schema_map(people):
    r = profile.completeness(people).first()
    assert r["cells"] == 28 and r["non_null_cells"] == 23
    sm = {r["column"]: r for r in profile.schema_map(people).collect()}
    assert sm["age"]["min"] == 25.0 and sm["name"]["min"] is None


def test_unknown_column_raises(people):
    with pytest.raises(ValueError, match="available"):
        profile.column_profile(people, "nope")


TIES = [("a", 1), ("b", 1), ("a", 3), ("b", 3), (None, 5)]


def test_group_stats_funcs(spark):
    df = spark.createDataFrame(TIES, "k string, v int")
    assert rows(stats.group_stats(df, "k", "v", "sum")) == [("a", 4), ("b", 4)]  # ties by key; NULL key dropped
    s = dict(rows(stats.group_stats(df, "k", "v", "std")))
    assert s["a"] == pytest.approx(math.sqrt(2))
    with pytest.raises(ValueError):
        stats.group_stats(df, "k", "v", "median")


def test_group_sum_all_missing_is_zero(spark):
    df = spark.createDataFrame([("g", None), ("g", None)], "g string, v double")
    assert rows(stats.group_stats(df, "g", "v", "sum")) == [("g", 0.0)]
    assert rows(stats.group_stats(df, "g", "v", "mean")) == [("g", None)]
    assert rows(stats.group_stats(df, "g", "v", "count")) == [("g", 0)]


def test_single_value_std_is_null(spark):
    df = spark.createDataFrame([("g", 1.5)], "g string, v double")
    assert rows(stats.group_stats(df, "g", "v", "std")) == [("g", None)]


def test_value_counts_share_of_present(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    got = rows(stats.value_counts(df, "c"))
    assert got == [("x", 2, 66.67), ("y", 1, 33.33)]


def test_correlation_symmetric_and_constant_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    m = {(r["col_x"], r["col_y"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert m[("a", "b")] == pytest.approx(m[("b", "a")])
    assert m[("a", "a")] == 1.0 and m[("c", "c")] is None and m[("a", "c")] is None
    strong = rows(stats.strong_correlations(df), "col_x", "col_y")
    assert strong == [("a", "b")]


def test_wide_correlation_matches_pandas_pairwise(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    n, k = 400, 12
    base = rng.normal(size=(n, 1))
    data = base * rng.uniform(-2, 2, size=(1, k)) + rng.normal(size=(n, k)) + 1e6  # large means
    data[rng.random((n, k)) < 0.15] = np.nan                                         # gaps per column
    data[:, 3] = 7.0                                                                 # a constant column
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(k)])
    df = spark.createDataFrame(pdf)
    assert len(df.columns) > 8
    got = {(r["col_x"], r["col_y"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    exp = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            e = exp.loc[a, b]
            if np.isnan(e):
                assert got[(a, b)] is None
            else:
                assert got[(a, b)] == pytest.approx(e, abs=1e-9)


def test_value_count_shares_sum_to_100(spark):
    df = spark.createDataFrame([(f"v{i % 7}",) for i in range(1000)] + [(None,)], "c string")
    shares = [r["pct"] for r in stats.value_counts(df, "c").collect()]
    assert sum(shares) == pytest.approx(100, abs=0.05)


def test_approx_switches_run_and_stay_close(spark):
    from tablescope.operators import clean, outliers
    rows_ = [(float(i % 101), f"k{i % 13}") for i in range(3000)] + [(None, None)]
    df = spark.createDataFrame(rows_, "x double, s string")
    exact = {r["column"]: r for r in profile.describe_numeric(df).collect()}["x"]
    approx = {r["column"]: r for r in profile.describe_numeric(df, approx=True).collect()}["x"]
    assert abs(approx["p50"] - exact["p50"]) <= 1.0
    sm = {r["column"]: r["distinct"] for r in profile.schema_map(df, approx=True).collect()}
    assert abs(sm["x"] - 101) <= 5 and abs(sm["s"] - 13) <= 1
    assert profile.describe_text(df, approx=True).first()["unique"] in range(12, 15)
    assert outliers.iqr_outliers(df, "x", approx=True).first()["outliers"] == 0
    assert clean.fill_median(df, approx=True).where("x IS NULL").count() == 0


def test_group_summary_equals_group_stats(spark):
    df = spark.createDataFrame(TIES + [("a", None), ("c", 7)], "k string, v int")
    summary = stats.group_summary(df, "k", "v")
    for func in stats.GROUP_FUNCS:
        assert rows(stats.ranked(summary, "k", func)) == rows(stats.group_stats(df, "k", "v", func))
