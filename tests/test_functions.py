"""Distributed quantiles and modes against brute force (numpy / pandas)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import modes, quantile_values, quantiles
from tablescope.functions.exprs import corr_of, std_of, strip_ws


def _np_q(values, p):
    return float(np.quantile(np.array(values, dtype=float), p, method="linear"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_numpy(spark, seed):
    rnd = random.Random(seed)
    vals = [rnd.choice([rnd.random() * 100, 7.0, None, float("nan")]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantile_values(df, "x", probs)["x"]
    clean = [v for v in vals if v is not None and not math.isnan(v)]
    for p in probs:
        assert got[p] == pytest.approx(_np_q(clean, p), rel=1e-12, abs=1e-12)


def test_quantiles_hot_value_and_hot_group(spark):
    # one value holds more than a third of the rows; one group holds most rows
    data = [("hot", 5.0)] * 4000 + [("hot", float(i)) for i in range(3000)] + \
           [("cold", float(i % 17)) for i in range(500)] + [("tiny", 1.0)]
    df = spark.createDataFrame(data, "g string, x double")
    q = quantiles(df, ["x"], [0.25, 0.5, 0.75], by=["g"], num_partitions=16)
    got = {(r["g"], r["p"]): r["value"] for r in q.collect()}
    pdf = pd.DataFrame(data, columns=["g", "x"])
    for g, part in pdf.groupby("g"):
        for p in (0.25, 0.5, 0.75):
            assert got[(g, p)] == pytest.approx(_np_q(part["x"].tolist(), p))


def test_quantiles_many_columns_and_ints(spark):
    pdf = pd.DataFrame({"a": np.arange(1, 101), "b": np.arange(100, 0, -1) * 1.5})
    df = spark.createDataFrame(pdf)
    got = quantile_values(df, ["a", "b"], [0.25, 0.5])
    assert got["a"][0.25] == pytest.approx(np.quantile(pdf["a"], 0.25))
    assert got["b"][0.5] == pytest.approx(np.quantile(pdf["b"], 0.5))


def test_quantiles_edge_cases(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantile_values(df, "x", [0.5])["x"][0.5] is None
    one = spark.createDataFrame([(3.0,)], "x double")
    assert quantile_values(one, "x", [0.0, 0.5, 1.0])["x"] == {0.0: 3.0, 0.5: 3.0, 1.0: 3.0}
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert quantile_values(four, "x", [0.25, 0.5, 0.75])["x"] == {0.25: 1.75, 0.5: 2.5, 0.75: 3.25}
    with pytest.raises(ValueError):
        quantiles(four, "x", [1.5])


def test_approx_quantiles_return_elements(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    got = quantile_values(df, "x", [0.25], approx=True)["x"][0.25]
    assert got in {0.0, 1.0, 2.0, 3.0}


def test_modes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 2), ("a", 1), (None, None), ("c", 3)],
                               "k string, v int")
    got = {r["column"]: (r["value"], r["freq"]) for r in modes(df, ["k", "v"]).collect()}
    assert got["k"] == ("a", 2)
    assert got["v"] == ("1", 2)


def test_modes_match_pandas(spark):
    rnd = random.Random(7)
    vals = [rnd.choice("abcdefg") for _ in range(2000)] + ["zz"] * 900
    df = spark.createDataFrame([(v,) for v in vals], "k string")
    r = modes(df, ["k"]).first()
    assert r["value"] == pd.Series(vals).mode().iloc[0]
    assert r["freq"] == 900


def test_std_exact_and_constant_corr(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "a int, b double")
    r = df.agg(std_of(F.col("a"), df.schema["a"].dataType).alias("s"),
               corr_of(F.col("a"), F.col("b"), df.schema["a"].dataType, df.schema["b"].dataType).alias("r")).first()
    assert r["s"] == pytest.approx(1.0)
    assert r["r"] is None  # constant column: NULL, not an ANSI error


def test_strip_ws_keeps_null(spark):
    df = spark.createDataFrame([(" a\t",), ("\n b \r",), (None,), ("c",)], "s string")
    assert [r[0] for r in df.select(strip_ws(F.col("s"))).collect()] == ["a", "b", None, "c"]
