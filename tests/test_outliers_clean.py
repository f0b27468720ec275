"""Outliers and cleaning on edge fixtures, plus properties."""

import pytest

from tablescope.operators import clean, outliers
from tests.conftest import rows


def _with_outliers(k):
    base = [float(i % 20) for i in range(400)]
    return base + [1000.0 + i for i in range(k)]


@pytest.mark.parametrize("k,expected", [(0, 0), (10, 10), (11, 5)])
def test_outlier_samples_all_or_five(spark, k, expected):
    df = spark.createDataFrame([(v,) for v in _with_outliers(k)], "x double")
    s = outliers.outlier_samples(df, "x", "iqr")
    assert s.count() == expected
    if k == 11:
        assert [r["value"] for r in s.orderBy("rank").collect()] == [1010.0, 1009.0, 1008.0, 1007.0, 1006.0]


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(3.0,)] * 10, "x double")
    z = outliers.zscore_outliers(df, "x").first()
    i = outliers.iqr_outliers(df, "x").first()
    assert z["outliers"] == 0 and i["outliers"] == 0 and i["iqr"] == 0.0
    assert outliers.outlier_summary(df, "x").first()["verdict"] == outliers.VERDICT_NONE


def test_single_value_std_null(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert outliers.outlier_stats(df, "x").first()["std"] is None


def test_zscore_invariant_under_shift_and_scale(spark):
    vals = _with_outliers(3) + [-500.0]
    a = spark.createDataFrame([(v,) for v in vals], "x double")
    b = spark.createDataFrame([(v * 3 + 100,) for v in vals], "x double")
    assert outliers.zscore_outliers(a, "x").first()["outliers"] == outliers.zscore_outliers(b, "x").first()["outliers"]


def test_flags_agree_with_counts(spark):
    df = spark.createDataFrame([(v,) for v in _with_outliers(4)] + [(None,)], "x double")
    f = outliers.outlier_flags(df, "x")
    assert f.where("is_iqr_outlier").count() == outliers.iqr_outliers(df, "x").first()["outliers"]
    assert f.where("x IS NULL").first()["is_z_outlier"] is None


def test_non_numeric_and_bad_method_raise(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        outliers.outlier_stats(df, "s")
    num = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        outliers.outlier_summary(num, "x", "mad")


PEOPLE = [
    (1, "  Ann ", 30.0, "Oslo"),
    (2, "Ann", float("nan"), None),
    (3, None, 41.0, "\tBergen\n"),
    (4, "Bob", None, "Oslo"),
    (4, "Bob", None, "Oslo"),
    (5, "Cy", 25.0, "Oslo "),
    (5, "Cy", 25.0, "Oslo"),
]


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, age double, city string")


def test_quick_clean_order_dedupe_then_trim(people):
    out = clean.quick_clean(people)
    got = sorted(rows(out), key=lambda r: (r[0], str(r[1]), r[3]))
    # the duplicate is gone; rows equal only after trimming stay (dedupe runs first)
    assert len(got) == 6
    assert sum(1 for r in got if r[0] == 5) == 2
    # median of ages present after dedupe: [30, 41, 25, 25] -> 27.5; mode of name: smallest of ties
    assert {r[2] for r in got if r[0] in (2, 4)} == {27.5}
    assert [r[1] for r in got if r[0] == 3] == ["Ann"]
    assert [r[3] for r in got if r[0] == 3] == ["Bergen"]
    assert [r[3] for r in got if r[0] == 2] == ["Oslo"]


def test_trim_first_collapses_trimmed_duplicates(people):
    assert clean.quick_clean(people, trim_first=True).count() == 5


def test_cleaned_has_no_gaps_and_dedupe_idempotent(people):
    out = clean.quick_clean(people)
    for c in out.columns:
        assert out.where(out[c].isNull()).count() == 0
    d = clean.dedupe(people)
    assert clean.dedupe(d).count() == d.count()


def test_fill_leaves_all_null_column(spark):
    df = spark.createDataFrame([("g", None), ("h", None)], "g string, v double")
    df2 = spark.createDataFrame([(None, 1.0), (None, 2.0)], "g string, v double")
    assert clean.fill_median(df).where("v IS NULL").count() == 2
    assert clean.fill_mode(df2).where("g IS NULL").count() == 2


def test_int_column_filled_becomes_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    out = clean.fill_median(df)
    assert out.schema["v"].dataType.simpleString() == "double"
    assert sorted(r[0] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_clean_report_steps(people):
    rep = rows(clean.clean_report(people), "operation", "column", "affected")
    assert rep[0] == ("dedupe", None, 1)
    assert ("fill_median", "age", 2) in rep
    assert ("fill_mode", "city", 1) in rep
    assert ("trim", "city", 2) in rep


def test_clean_with_report_matches_separate_calls(people):
    cleaned, report = clean.quick_clean_with_report(people)
    assert sorted(rows(cleaned), key=str) == sorted(rows(clean.quick_clean(people)), key=str)
    assert rows(report) == rows(clean.clean_report(people))


def test_mode_fill_of_typed_and_nested_columns(spark):
    import datetime as dt
    df = spark.createDataFrame(
        [([1.0, 2.0], True, dt.date(2023, 1, 2)), ([1.0, 2.0], True, dt.date(2023, 1, 2)),
         ([3.0], False, None), (None, None, dt.date(2023, 1, 2))],
        "v array<double>, b boolean, d date")
    out = clean.fill_mode(df)
    assert out.where("v IS NULL OR b IS NULL OR d IS NULL").count() == 0
    assert sorted(tuple(r["v"]) for r in out.collect()) == [(1.0, 2.0), (1.0, 2.0), (1.0, 2.0), (3.0,)]
    assert out.where("b").count() == 3 and out.where("d = DATE'2023-01-02'").count() == 4
