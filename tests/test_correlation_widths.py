"""The correlation of two columns does not depend on how many others there are."""

import math
import random
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import functions as F

from tablescope.operators import stats


def test_big_integers_are_exact_at_every_width(spark):
    x = F.lit(2**53) + F.col("id") % 2
    df = spark.range(1000).select(x.alias("x"), (F.col("id") % 2 * 3).alias("y"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("z"),
                                  (F.col("id") % 2).cast("decimal(30,2)").alias("p"), F.lit(Decimal("1.50")).alias("q"), (F.col("id") % 7).cast("double").alias("f"),
                                  *[((F.col("id") * (i + 3)) % 11).cast("int").alias(f"c{i}") for i in range(4)])
    cell = lambda m: {(r.col_x, r.col_y): r.r for r in m.collect()}
    wide, narrow = cell(stats.correlation_matrix(df)), cell(stats.correlation_matrix(df, ["x", "y", "z", "p", "q", "f"]))
    assert len(df.columns) > 8 and len(wide) == len(df.columns) ** 2
    assert abs(wide["x", "y"] - 1) < 1e-12 and wide["x", "x"] == 1.0 and wide["q", "q"] is None and wide["q", "x"] is None
    for k, r in narrow.items():
        if "f" not in k:
            assert wide[k] == r
        elif "x" not in k:
            assert wide[k] == r or abs(wide[k] - r) < 1e-12


def test_pairs_equal_exact_fractions(spark):
    """Huge longs and decimals, gaps, constant and empty columns, every pair against exact arithmetic."""
    rng = random.Random(6)
    rows = [(rng.choice([None, rng.randrange(-2**63, 2**63)]), rng.randrange(2**40) * 3 + i, Decimal(rng.randrange(-10**37, 10**37)).scaleb(-10) if i % 7 else None,
             rng.choice([None, Decimal(rng.randrange(10**6)).scaleb(-2)]), 5, None, i % 5) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long, c decimal(38,10), d decimal(10,2), e int, f long, g byte").repartition(5)
    got = {(r.col_x, r.col_y): r.r for r in stats.correlation_matrix(df).collect()}
    with localcontext() as ctx:
        ctx.prec = 60
        for i, x in enumerate(df.columns):
            for j, y in enumerate(df.columns):
                pairs = [(Fraction(r[i]), Fraction(r[j])) for r in rows if r[i] is not None and r[j] is not None]
                n, sx, sy = len(pairs), sum(p[0] for p in pairs), sum(p[1] for p in pairs)
                cov, vx, vy = n * sum(p * q for p, q in pairs) - sx * sy, n * sum(p * p for p, _ in pairs) - sx * sx, n * sum(q * q for _, q in pairs) - sy * sy
                want = None if n < 2 or not vx or not vy else 1.0 if i == j else float(cov) / (math.sqrt(vx) * math.sqrt(vy))
                assert got[x, y] == want, (x, y)
    assert len(got) == 49 and got["e", "a"] is None and got["f", "f"] is None
    empty = stats.correlation_matrix(df.limit(0)).collect()
    assert len(empty) == 49 and all(r.r is None for r in empty)
