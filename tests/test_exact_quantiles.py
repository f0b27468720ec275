"""Quantiles selected inside brackets: exact in the column's own type, at every bracket size."""

import contextlib
import importlib
import io
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablescope.functions import quantile_values

q = importlib.import_module("tablescope.functions.quantiles")
PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]


def brute(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    return v[math.floor(at)], v[math.ceil(at)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        hot = rng.random() < 0.4
        rows.append((None if rng.random() < .1 else 7 if hot else rng.randrange(-50, 5000), 2 ** 53 + rng.randrange(400) if rng.random() < .9 else -(2 ** 62) + i,
                     rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1e9), rng.random(), -0.0, 5e-324]), Decimal(rng.randrange(10 ** 9)) / 100,
                     None, i % 3, float(rng.randrange(8)) / 10))
    df = spark.createDataFrame(rows, "a long, b long, c double, d decimal(20,2), e double, f int, g float").repartition(6)
    return df, rows


@pytest.mark.parametrize("inside, accuracy", [(200_000, 2000), (300, 50), (1, 2000), (1, 3)])
def test_ranks_equal_sorting(table, monkeypatch, inside, accuracy):
    monkeypatch.setattr(q, "INSIDE", inside)
    monkeypatch.setattr(q, "ACCURACY", accuracy)
    df, rows = table
    got = q.exact_ranks(df, df.columns, PROBS)
    assert "e" not in got and sorted(got) == ["a", "b", "c", "d", "f", "g"]
    for k, c in enumerate(df.columns):
        values = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        if c == "g":
            values = [as_float32(v) for v in values]
        for p in PROBS if c != "e" else ():
            assert got[c][p][:2] == brute(values, p), (c, p)


def as_float32(v):
    import struct
    return struct.unpack("f", struct.pack("f", v))[0]


def test_longs_that_doubles_cannot_tell_apart(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(big + 1,), (big + 3,), (big + 5,)], "x long")
    assert q.exact_ranks(df, ["x"], [0.5])["x"][0.5] == (big + 3, big + 3, 0.0)
    many = spark.range(3001).select((F.lit(2 ** 62) + F.col("id") * 3).alias("x"))
    assert q.exact_ranks(many, ["x"], [0.5, 0.25])["x"] == {0.25: (2 ** 62 + 2250, 2 ** 62 + 2250, 0.0), 0.5: (2 ** 62 + 4500, 2 ** 62 + 4500, 0.0)}


def test_decimals_at_the_ends_of_their_type(spark):
    df = spark.createDataFrame([(Decimal("9" * 38),), (Decimal("-" + "9" * 38),), (Decimal(1),)], "x decimal(38,0)")
    assert q.exact_ranks(df, ["x"], [0.0, 0.5, 1.0])["x"] == {0.0: (Decimal("-" + "9" * 38),) * 2 + (0.0,), 0.5: (Decimal(1),) * 2 + (0.0,), 1.0: (Decimal("9" * 38),) * 2 + (0.0,)}


def test_nothing_is_written_and_values_are_pruned(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "cast(id % 1000 as double) as x", "'t' as other").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = set(tmp_path.iterdir())
    assert quantile_values(df, ["id", "x"], [0.5]) == {"id": {0.5: 49999.5}, "x": {0.5: 499.5}}
    assert set(tmp_path.iterdir()) == before
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.select("x").where("x is not null").explain("formatted")
    assert "ReadSchema: struct<x:double>" in out.getvalue()
