"""Pairwise sums of any number of columns in one pass, exact for integers and decimals.

Every task adds up matrices over its rows: counts, sums, squares and products of each
pair of columns over the rows where both are present. Integers and unscaled decimals
are cut into limbs of LIMB bits, so a matrix product of limbs over CHUNK rows is exact
in doubles; the limbs are put together again as whole numbers. Whole numbers travel as
digits of DIGIT bits, which Spark sums as longs, and are combined at the end, one row a
pair. Columns of doubles are summed around their means. A task sends k * (k + 1) / 2
rows, whatever it has read; no row of the table is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import is_exact_numeric, missing_as_null

LIMB, CHUNK, DIGIT, DIGITS = 19, 2048, 40, 8
#: Chunks whose limb sums (below 2**52 each) a 64-bit whole number holds.
HELD = 1024
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(present, values): longs as they are, decimals unscaled, as int64 or Python integers."""
    there = np.asarray(column.is_valid())
    if not pa.types.is_decimal(column.type):
        return there, column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset:2 * (column.offset + len(column))].reshape(-1, 2)
    low, high = np.where(there, parts[:, 0], 0), np.where(there, parts[:, 1], 0)
    if (high == low >> 63).all():
        return there, low
    return there, (high.astype(object) << 64) + low.view(np.uint64).astype(object)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """``values`` as limbs from the lowest; the last one carries the sign."""
    out = []
    while values.size and max(int(values.max()), -int(values.min()) - 1) >> LIMB:
        out.append((values & ((1 << LIMB) - 1)).astype(np.float64))
        values = values >> LIMB
    return [*out, values.astype(np.float64)]


def _chunk(columns: list[pa.Array], floats: list[np.ndarray | None]) -> list[dict]:
    """Sums of one chunk, by limb: counts, sums, squares, products, whole numbers below 2**52."""
    k = len(columns)
    there, parts = np.zeros((k, len(columns[0]))), []
    for i, c in enumerate(columns):
        if floats[i] is None:
            there[i], values = _whole(c)
            parts.append(_limbs(values))
        else:
            there[i] = ~np.isnan(floats[i])
            parts.append([])
    depth = max(map(len, parts), default=1) or 1
    limbs = np.zeros((k, depth, there.shape[1]))
    for i, p in enumerate(parts):
        for t, limb in enumerate(p):
            limbs[i, t] = limb
    flat = limbs.reshape(k * depth, -1)
    product = (flat @ flat.T).reshape(k, depth, k, depth)
    count, total = there @ there.T, (flat @ there.T).reshape(k, depth, k)
    square = np.zeros((k, 2 * depth - 1, k))
    for a in range(depth):
        for b in range(depth):
            if there.all():
                square[:, a + b] += np.einsum("ii->i", product[:, a, :, b])[:, None]
            else:
                square[:, a + b] += (limbs[:, a] * limbs[:, b]) @ there.T
    mixed = np.zeros((k, 2 * depth - 1, k))
    for a in range(depth):
        for b in range(depth):
            mixed[:, a + b] += product[:, a, :, b]
    return [count[:, None], total, square, mixed]


def _joined(sums: list[np.ndarray | None]) -> list[np.ndarray]:
    """Limb sums (k, depth, k) -> whole numbers (k, k)."""
    out = []
    for s in sums:
        whole = np.zeros((s.shape[0], s.shape[2]), object)
        for t in range(s.shape[1]):
            whole = whole + (s[:, t].astype(np.int64).astype(object) << (LIMB * t))
        out.append(whole)
    return out


def _partial(k: int, exact: list[bool], shift: list[float]):
    """Batches of the columns -> one row a pair: digits of the whole sums, doubles of the others."""
    both = np.array(exact)[:, None] & np.array(exact)[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [np.zeros((k, k), object) for _ in range(4)]
        real = [np.zeros((k, k)) for _ in range(4)]
        held, chunks = None, 0

        def settle():
            nonlocal whole, held, chunks
            if held is not None:
                whole = [w + h for w, h in zip(whole, _joined(held), strict=True)]
            held, chunks = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                columns = [part.column(i) for i in range(k)]
                floats = [None if exact[i] else columns[i].to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)]
                sums = _chunk(columns, floats)
                if held is not None and [s.shape for s in sums] != [h.shape for h in held]:
                    settle()
                held = sums if held is None else [h + s for h, s in zip(held, sums, strict=True)]
                if all(exact):
                    held = [h.astype(np.int64) for h in held]
                chunks += 1
                if chunks == HELD or not all(exact):
                    settle()
                if not all(exact):
                    z = np.stack([c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) if floats[i] is None else floats[i] for i, c in enumerate(columns)])
                    z = z - np.array(shift)[:, None]
                    there = ~np.isnan(z)
                    z, there = np.where(there, z, 0.0), there.astype(np.float64)
                    for acc, add in zip(real, (there @ there.T, z @ there.T, (z * z) @ there.T, z @ z.T), strict=True):
                        acc += add
        settle()
        rows = []
        for i in range(k):
            for j in range(i, k):
                n, x, xx, xy = whole
                numbers = [n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]] if both[i, j] else [0] * 6
                row = {"i": i, "j": j}
                for name, value in zip(_SUMS, numbers, strict=True):
                    for t in range(DIGITS):
                        row[f"{name}{t}"] = int(value) >> (DIGIT * t) if t == DIGITS - 1 else (int(value) >> (DIGIT * t)) & ((1 << DIGIT) - 1)
                n, x, xx, xy = real
                row |= dict(zip((f"r{name}" for name in _SUMS), (float(v) for v in (n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j])), strict=True))
                rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int32() if c in "ij" else pa.float64() if c.startswith("r") else pa.int64()) for c in rows[0]]))
    return run


def _correlated(exact: list[bool], scales: list[int]):
    """Summed rows of pairs -> (ix, iy, r)."""
    def exactly(i, j, n, x, y, xx, yy, xy):
        def number(value, scale):
            return float(Fraction(value, 10 ** scale))
        cov, vx, vy = number(n * xy - x * y, scales[i] + scales[j]), number(n * xx - x * x, 2 * scales[i]), number(n * yy - y * y, 2 * scales[j])
        return None if n < 2 or not vx or not vy else 1.0 if i == j else cov / (math.sqrt(vx) * math.sqrt(vy))

    def nearly(i, j, n, x, y, xx, yy, xy):
        vx, vy = n * xx - x * x, n * yy - y * y
        if n < 2 or not vx > 0 or not vy > 0:
            return None
        return 1.0 if i == j else min(1.0, max(-1.0, (n * xy - x * y) / (math.sqrt(vx) * math.sqrt(vy))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                i, j = row["i"], row["j"]
                if exact[i] and exact[j]:
                    r = exactly(i, j, *(sum(row[f"{name}{t}"] << (DIGIT * t) for t in range(DIGITS)) for name in _SUMS))
                else:
                    r = nearly(i, j, *(row[f"r{name}"] for name in _SUMS))
                out += [(i, j, r)] if i == j else [(i, j, r), (j, i, r)]
            ix, iy, r = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ix, pa.int32()), pa.array(iy, pa.int32()), pa.array(r, pa.float64())], names=["ix", "iy", "r"])
    return run


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ix, iy, r): Pearson r of every pair of ``cols`` by position, over the rows where
    both are present; NULL for fewer than two rows or a constant column."""
    types = [df.schema[c].dataType for c in cols]
    exact = [is_exact_numeric(t) for t in types]
    scales = [t.scale if isinstance(t, T.DecimalType) else 0 for t in types]
    k = len(cols)
    d = df.select(*[missing_as_null(df, c).cast(t if isinstance(t, T.DecimalType) else T.LongType() if e else T.DoubleType()).alias(f"c{i}")
                    for i, (c, t, e) in enumerate(zip(cols, types, exact, strict=True))])
    shift = [0.0] * k
    if not all(exact):
        means = d.agg(*[F.avg(F.col(f"c{i}").cast("double")).alias(f"m{i}") for i in range(k)]).first()
        shift = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    whole = [f"{name}{t}" for name in _SUMS for t in range(DIGITS)]
    real = [f"r{name}" for name in _SUMS]
    schema = "i int, j int, " + ", ".join([f"{c} long" for c in whole] + [f"{c} double" for c in real])
    none = df.sparkSession.createDataFrame([(i, j, *[0] * len(whole), *[0.0] * len(real)) for i in range(k) for j in range(i, k)], schema)
    sums = d.mapInArrow(_partial(k, exact, shift), schema).unionByName(none).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in [*whole, *real]])
    return sums.mapInArrow(_correlated(exact, scales), "ix int, iy int, r double")
