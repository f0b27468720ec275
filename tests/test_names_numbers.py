"""Column names with dots, spaces and backticks in every operator; numbers beyond DECIMAL(38)."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import quantiles
from tablescope.operators import chartdata, clean, outliers, profile, stats, steps, trend
from tests.conftest import rows

K, V, D = "Reg.No", "a `b`", "x.1"


@pytest.fixture(scope="module")
def odd(spark):
    data = [("u", 1.0, "2024-01-01"), ("u", 3.0, "2024-02-01"), ("w", 5.0, "2024-03-01"), ("w", None, None), ("u", 1.0, "2024-01-01")]
    return spark.createDataFrame(data, "k string, v double, d string").toDF(K, V, D)


OPERATORS = {
    "overview": lambda df: profile.overview(df), "missing": lambda df: profile.missing(df), "duplicates": lambda df: profile.duplicates(df),
    "describe_numeric": lambda df: profile.describe_numeric(df), "describe_text": lambda df: profile.describe_text(df),
    "column_profile": lambda df: profile.column_profile(df, V), "top_values": lambda df: profile.top_values(df, K),
    "samples": lambda df: profile.samples(df, V), "schema_map": lambda df: profile.schema_map(df),
    "completeness": lambda df: profile.completeness(df), "group_stats": lambda df: stats.group_stats(df, K, V, "mean"),
    "group_summary": lambda df: stats.group_summary(df, K, V), "value_counts": lambda df: stats.value_counts(df, K),
    "correlation": lambda df: stats.correlation_matrix(df), "outlier_stats": lambda df: outliers.outlier_stats(df, V),
    "zscore": lambda df: outliers.zscore_outliers(df, V), "iqr": lambda df: outliers.iqr_outliers(df, V),
    "range": lambda df: outliers.outlier_range(df, V, limit=0.5, k=0.1), "outlier_samples": lambda df: outliers.outlier_samples(df, V, limit=0.5, k=0.1),
    "summary": lambda df: outliers.outlier_summary(df, V), "flags": lambda df: outliers.outlier_flags(df, V),
    "quick_clean": lambda df: clean.quick_clean(df), "clean_report": lambda df: clean.clean_report(df),
    "bar": lambda df: chartdata.bar(df, K), "bar_sum": lambda df: chartdata.bar(df, K, V), "pie": lambda df: chartdata.pie(df, K),
    "line": lambda df: chartdata.line(df, D, V), "histogram": lambda df: chartdata.histogram(df, V, 3),
    "box": lambda df: chartdata.box(df, V), "box_grouped": lambda df: chartdata.box(df, K, V),
    "totals": lambda df: trend.period_totals(df, D, V), "trend_range": lambda df: trend.trend_range(df, D, V),
    "quality": lambda df: trend.trend_quality(df, D, V), "drop_missing": lambda df: steps.drop_missing(df),
    "year": lambda df: steps.filter_year_category(df, D, 2024, K, "u"), "quantiles": lambda df: quantiles(df, V, [0.5], by=[K]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_column_name(odd, name):
    assert OPERATORS[name](odd).collect()


def test_results_do_not_depend_on_the_names(odd):
    plain = odd.toDF("k", "v", "d")
    assert rows(stats.group_summary(odd, K, V).orderBy(F.col("count"))) == rows(stats.group_summary(plain, "k", "v").orderBy("count"))
    assert sorted(rows(clean.quick_clean(odd))) == sorted(rows(clean.quick_clean(plain)))


def test_numbers_beyond_decimal_38(spark):
    base = 4 * 10**18
    ints = spark.range(1000).select((F.lit(base) + F.col("id") * 10**15).alias("x"), (F.lit(base) - F.col("id") * 10**15).alias("y"))
    m = outliers.moments(ints, "x")
    want = np.array([base + i * 10**15 for i in range(1000)], float)
    assert m.mean == pytest.approx(want.mean()) and m.std == pytest.approx(want.std(ddof=1), rel=1e-6)
    r = {(a, b): v for a, b, v in rows(stats.correlation_matrix(ints), "col_x", "col_y", "r")}
    assert r["x", "y"] == pytest.approx(-1.0, abs=1e-6)
    big = [Decimal(10) ** 20, -Decimal(10) ** 20, Decimal(5), Decimal(9)]
    df = spark.createDataFrame([(v,) for v in big], "v decimal(38,0)")
    assert outliers.moments(df, "v").std == pytest.approx(np.std([float(v) for v in big], ddof=1))
