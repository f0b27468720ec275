"""A third of all rows in one key / one value: results stay exact (brute force
with pandas/numpy), whatever the physical plan does with the hot key."""

import random

import numpy as np
import pandas as pd
import pytest

from tablescope.operators import chartdata, clean, profile, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = [("hot", round(rnd.gauss(50, 10), 2)) for _ in range(6000)]
    rows += [("hot", 42.0)] * 4000                      # a hot value inside the hot key
    rows += [(f"k{rnd.randint(0, 499)}", round(rnd.uniform(0, 100), 2)) for _ in range(20000)]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    return spark.createDataFrame(rows, "g string, v double").repartition(16), pdf


def test_group_stats_hot_key(skewed):
    df, pdf = skewed
    got = {r["g"]: r["std"] for r in stats.group_stats(df, "g", "v", "std").collect()}
    exp = pdf.groupby("g")["v"].std()
    assert got["hot"] == pytest.approx(exp["hot"])
    assert len(got) == len(exp)


def test_box_grouped_hot_key(skewed):
    df, pdf = skewed
    got = {r["g"]: r for r in chartdata.box(df, "g", "v").collect()}
    for g in ("hot", "k7"):
        vals = pdf.loc[pdf.g == g, "v"].to_numpy()
        q1, med, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
        assert (got[g]["q1"], got[g]["median"], got[g]["q3"]) == pytest.approx((q1, med, q3))
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert got[g]["n_outliers"] == int(((vals < lo) | (vals > hi)).sum())


def test_duplicates_and_value_counts_hot_row(skewed):
    df, pdf = skewed
    r = profile.duplicates(df).first()
    assert r["duplicate_rows"] == int(pdf.duplicated().sum())
    top = stats.value_counts(df, "g", 1).first()
    assert (top["g"], top["count"]) == ("hot", 10000)


def test_median_fill_hot_value(spark, skewed):
    _, pdf = skewed
    rows = [(None if i % 9 == 0 else v,) for i, v in enumerate(pdf["v"].tolist())]
    df = spark.createDataFrame(rows, "v double")
    med = float(np.median([r[0] for r in rows if r[0] is not None]))
    filled = clean.fill_median(df)
    assert filled.where(filled.v == med).count() == sum(1 for r in rows if r[0] is None or r[0] == med)
