"""Randomised properties (Hypothesis): distributed exact quantiles and modes
equal brute force on any small input, whatever the partitioning."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablescope.functions import modes, quantiles

values = st.one_of(st.none(), st.just(float("nan")),
                   st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False))
rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), values), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 5))
def test_grouped_quantiles_equal_numpy(spark, data, parts):
    df = spark.createDataFrame(data, "g string, x double").repartition(parts)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in quantiles(df, ["x"], probs, by=["g"], num_partitions=parts).collect()}
    pdf = pd.DataFrame(data, columns=["g", "x"])
    for g, part in pdf.groupby("g"):
        xs = [v for v in part["x"] if v is not None and not math.isnan(v)]
        for p in probs:
            if not xs:
                assert (g, p) not in got
            else:
                assert got[(g, p)] == pytest.approx(float(np.quantile(xs, p)), rel=1e-9, abs=1e-6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from(["x", "y", "z", None]), st.integers(-12, 12)), min_size=1, max_size=60))
def test_modes_equal_pandas(spark, data):
    df = spark.createDataFrame(data, "s string, n int").repartition(3)
    got = {r["column"]: (r["value"], r["freq"]) for r in modes(df, ["s", "n"]).collect()}
    pdf = pd.DataFrame(data, columns=["s", "n"])
    for col in ("s", "n"):
        present = pdf[col].dropna()
        if present.empty:
            assert col not in got
            continue
        counts = present.value_counts()
        top = counts.max()
        tied = [v for v, c in counts.items() if c == top]
        best = min(tied) if col == "s" else str(int(min(tied)))
        assert got[col] == (best, int(top))
