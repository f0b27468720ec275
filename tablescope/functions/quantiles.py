"""Exact and approximate quantiles that never pull one group into one task.

Spark's exact ``percentile`` aggregate merges a value->count map of the whole
group in one task; for a global quantile over 100 TB that is the whole column
in one task.

Of whole columns (``by=()``), ``quantiles`` selects inside brackets: one pass of
``percentile_approx`` sketches bounds every wanted rank of every column from both
sides, one counts exactly what lies below and inside, one keeps only the values inside,
grouped and counted. Brackets that hold more than ``INSIDE`` rows are first narrowed by
a sketch of their own values, so what reaches the driver is bounded whatever the number
of rows; one that missed its rank is widened. Brackets are of the values as doubles,
which keep their order; the values inside are compared in the column's own type and
chosen exactly. Nothing is written, and the only shuffle is of the brackets.

Per group (``by``), it

1. counts each distinct (key, value) - map-side combined, so a value that
   holds a third of all rows becomes one row with a large weight;
2. range-partitions those weighted values by (key, value), so a hot key is
   spread over many partitions, and pins them with a reliable checkpoint in
   the session's ``spark.checkpoint.dir`` (range bounds come from sampling; the
   checkpoint fixes the partition ids and cuts the lineage; the range shuffle
   is computed once, via a short-lived cache);
3. computes the running weight inside each (key, partition) piece and the
   offset of each piece from a tiny per-(key, partition) total table;
4. keeps only the values whose rank interval covers one of the target ranks
   (at most 2 per probability and key) and interpolates.

Interpolation is linear on 0-based rank ``(n-1)*p`` (numpy "linear", DuckDB
``quantile_cont`` up to the last bit): ``lo + (pos - floor(pos)) * (hi - lo)``,
in doubles of the two exact values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col_of, is_exact_numeric, is_floating, missing_as_null, require_columns

BROADCAST_ROWS = 1_000_000
#: Relative rank error of a sketch is 1 / ACCURACY; rows that a bracket may hold when its values are collected.
ACCURACY, INSIDE = 2000, 200_000
#: Columns of one aggregation.
COLUMNS = 4


def _long_form(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows ``(by..., ci, x)``: ``ci`` is the int position of the column in ``cols``
    (cheaper to hash and shuffle than the name)."""
    items = []
    for i, c in enumerate(cols):
        x = col_of(c)
        if is_floating(df.schema[c].dataType):
            x = F.nanvl(x, F.lit(None).cast(df.schema[c].dataType))
        items.append(F.struct(F.lit(i).alias("ci"), x.cast("double").alias("x")))
    long = df.select(*[col_of(b) for b in by], F.inline(F.array(*items)))
    return long.where(F.col("x").isNotNull())


def _names(cols: Sequence[str]):
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("ci") + 1)


def _interpolate(n, segs, p):
    pos = (n - F.lit(1)).cast("double") * F.lit(float(p))
    lo = F.floor(pos)
    hi = F.ceil(pos)

    def at(rank):
        return F.filter(segs, lambda s: (s["start"] <= rank) & (rank < s["end"]))[0]["x"]

    v_lo, v_hi = at(lo), at(hi)
    return v_lo + (pos - lo) * (v_hi - v_lo)


@dataclass(eq=False)
class _Bracket:
    """Where the ranks ``first`` and ``last`` of a column are sought: among values from
    ``low`` to ``high`` (None: no bound). ``below`` and ``held`` rows are below and inside."""
    column: int
    p: float
    first: int
    last: int
    share: float
    low: object = None
    high: object = None
    below: int = 0
    held: int = 0
    error: float = 0.0
    tight: bool = False

    def under(self, x: Column) -> Column:
        return F.lit(False) if self.low is None else x < F.lit(self.low)

    def inside(self, x: Column) -> Column:
        low = x.isNotNull() if self.low is None else x >= F.lit(self.low)
        return low if self.high is None else low & (x <= F.lit(self.high))

    def around(self, sketch: Column, middle: float, spare: float) -> Column:
        """The sketched bounds of the ranks; ``settle`` takes what they turn out to be."""
        self._wanted = (middle - self.error - spare, middle + self.error + spare)
        return F.percentile_approx(sketch, [min(1.0, max(0.0, w)) for w in self._wanted], ACCURACY)

    def settle(self, bounds: list | None) -> None:
        # the ends of the data need no bound: a sketch's least value may not be the least
        low = None if bounds is None or self._wanted[0] <= 0 else bounds[0]
        high = None if bounds is None or self._wanted[1] >= 1 else bounds[1]
        low, high = self.low if low is None else low, self.high if high is None else high
        self.tight = (low, high) == (self.low, self.high) or (low is not None and low == high)
        self.low, self.high = low, high


def _comparable(df: DataFrame, c: str) -> tuple[Column, T.DataType]:
    """The column without NaN as long, decimal or double, whichever holds its values exactly."""
    dt = df.schema[c].dataType
    if not isinstance(dt, T.DecimalType):
        dt = T.LongType() if is_exact_numeric(dt) else T.DoubleType()
    return missing_as_null(df, c).cast(dt), dt


def exact_ranks(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, tuple]]:
    """{column: {p: (value at the rank below, value at the rank above, share between)}},
    values as Python numbers of the column's type. A column without values is left out.

    Every pass reads ``df`` once for all columns and ranks: a sketch, then the values
    inside the brackets with the counts below; for brackets that are large or missed
    their rank, exact counts, a sketch of what is inside and the values, until it is found.
    """
    made = [_comparable(df, c) for c in cols]
    types = [dt for _, dt in made]
    # Brackets are of the values as doubles, which keep their order; values are chosen as they are.
    d = df.select(*[x.cast("double").alias(f"c{i}") for i, (x, _) in enumerate(made)], *[x.alias(f"v{i}") for i, (x, _) in enumerate(made)])
    xs = [F.col(f"c{i}") for i in range(len(cols))]
    probs = sorted(set(probs))
    edges = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in probs for side in (-1, 1)]
    row = {}
    for r in _union(d.agg(*[F.count(xs[i]).alias(f"n{i}") for i in some], *[F.percentile_approx(xs[i], edges, ACCURACY).alias(f"q{i}") for i in some])
                    .select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n"), F.col(f"q{i}").alias("q")) for i in some])))
                    for some in _groups(range(len(cols)))).collect():
        row |= {f"n{r['i']}": r["n"], f"q{r['i']}": r["q"]}
    out: dict[str, dict[float, tuple]] = {}
    pending = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if not n:
            continue
        out[c] = {}
        for k, p in enumerate(probs):
            at = (n - 1) * p
            b = _Bracket(i, p, math.floor(at), math.ceil(at), at - math.floor(at), error=2 / ACCURACY)
            b._wanted = (p - b.error, p + b.error)
            b.settle(row[f"q{i}"][2 * k:2 * k + 2])
            pending.append(b)
    pending = _first_try(d, xs, pending, types, [row[f"n{i}"] for i in range(len(cols))], cols, out)
    while pending:
        counted = d.agg(*[F.count_if(b.under(xs[b.column])).alias(f"b{k}") for k, b in enumerate(pending)],
                        *[F.count_if(b.inside(xs[b.column])).alias(f"n{k}") for k, b in enumerate(pending)]).first()
        wide, narrow, ready = [], [], []
        for k, b in enumerate(pending):
            b.below, b.held = counted[f"b{k}"], counted[f"n{k}"]
            if b.below > b.first or b.below + b.held <= b.last:
                b.low, b.high = (None if b.below > b.first else b.low), (None if b.below + b.held <= b.last else b.high)
                b.error, b.tight = b.error * 8, False
                wide.append(b)
            else:
                (narrow if b.held > INSIDE and not b.tight else ready).append(b)
        if narrow:
            sketched = d.agg(*[b.around(F.when(b.inside(xs[b.column]), xs[b.column]), ((b.first + b.last) / 2 - b.below) / b.held, 1 / b.held).alias(f"q{k}")
                               for k, b in enumerate(narrow)]).first()
            for k, b in enumerate(narrow):
                b.settle(sketched[f"q{k}"])
        if ready:
            for b, values in zip(ready, _inside([(d, some) for some in _groups(sorted({b.column for b in ready}))], xs, ready, types), strict=True):
                out[cols[b.column]][b.p] = (*_ends(b, values), b.share)
        pending = wide + narrow
    return out


def _first_try(d, xs, brackets, types, counts, cols, out) -> list[_Bracket]:
    """Values inside the sketched brackets and what lies below, in one pass where the
    brackets are small; returns the brackets that are still open. What is observed on the
    way counts the rows of a repeated task twice: it holds only if the rows seen of each
    column are as many as there are."""
    small = [b for b in brackets if b.low is not None and b.low == b.high or 2 * b.error * counts[b.column] <= INSIDE]
    if not small:
        return brackets
    seen = [(Observation(), some) for some in _groups(sorted({b.column for b in small}))]
    found = _inside([(d.observe(o, *[F.count(xs[i]).alias(f"n{i}") for i in some], *[F.count_if(b.under(xs[b.column])).alias(f"b{k}") for k, b in enumerate(small) if b.column in some]), some)
                     for o, some in seen], xs, small, types)
    got = {k: v for o, _ in seen for k, v in o.get.items()}
    if any(got[f"n{i}"] != counts[i] for _, some in seen for i in some):
        return brackets
    left = [b for b in brackets if b not in small]
    for k, (b, values) in enumerate(zip(small, found, strict=True)):
        b.below = got[f"b{k}"]
        ends = _ends(b, values)
        if None in ends:
            left.append(b)
        else:
            out[cols[b.column]][b.p] = (*ends, b.share)
    return left


def _groups(columns: Sequence[int]) -> list[list[int]]:
    """Columns that share an aggregation: few, so that its code compiles; each reads its columns alone."""
    columns = list(columns)
    return [columns[k:k + COLUMNS] for k in range(0, len(columns), COLUMNS)]


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _inside(parts: list[tuple[DataFrame, list[int]]], xs: list[Column], brackets: list[_Bracket], types: list[T.DataType]) -> list[list]:
    """The distinct values inside each bracket and their counts, in order. ``parts``: the
    table, once for each group of columns."""
    cells = []
    for d, some in parts:
        own = [(k, b, b.inside(xs[b.column])) for k, b in enumerate(brackets) if b.column in some]
        cells.append(d.where(reduce(Column.__or__, [inside for _, _, inside in own])).select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("t"), F.when(inside, F.col(f"v{b.column}").cast("string")).alias("x")) for k, b, inside in own]))))
    found = _union(cells).where("x is not null").groupBy("t", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    values: list[list] = [[] for _ in brackets]
    for r in found:
        dt = types[brackets[r["t"]].column]
        read = float if is_floating(dt) else Decimal if isinstance(dt, T.DecimalType) else int
        values[r["t"]].append((read(r["x"]), r["n"]))
    return [sorted(v) for v in values]


def _ends(b: _Bracket, values: list) -> list:
    """The values at the two ranks of a bracket; None where it has missed one."""
    at, ends = b.below, [None, None]
    for x, n in values:
        for k, rank in enumerate((b.first, b.last)):
            if at <= rank < at + n:
                ends[k] = x
        at += n
    return ends


def _between(found: tuple) -> float:
    """Linear interpolation of (value below, value above, share between)."""
    low, high, share = found
    return float(low) if low == high else float(low) + share * (float(high) - float(low))


def quantiles(df: DataFrame, cols: str | Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), approx: bool = False, accuracy: int = 10000,
              num_partitions: int | None = None) -> DataFrame:
    """Quantiles of ``cols`` (per group of ``by``) as rows ``(by..., column, p, value)``.

    NULL and NaN are skipped. Keys with no value produce no row. ``approx=True``
    uses ``percentile_approx`` (an element of the data, rank error 1/accuracy).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    by = list(by)
    require_columns(df, *cols, *by)
    probs = [float(p) for p in probs]
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} outside [0, 1]")
    names = by + ["ci"]
    keys = [col_of(k) for k in names]
    if len(cols) > 1 and (by or approx):  # the unpivot multiplies rows: do it on all cores
        from ..session import spread
        df = spread(df.select(*map(col_of, [*by, *cols])))
    long = _long_form(df, cols, by)

    if approx:
        arr = F.percentile_approx("x", [float(p) for p in probs], accuracy)
        agg = long.groupBy(*keys).agg(arr.alias("qs"))
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), F.col("qs").alias("value"))
        return agg.select(*map(col_of, by), _names(cols).alias("column"), F.inline(pairs))

    spark = df.sparkSession
    if not by:
        rows = [(c, p, _between(r)) for c, found in exact_ranks(df, cols, probs).items() for p, r in found.items()]
        return spark.createDataFrame(rows, "column string, p double, value double")
    from ..session import materialize
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    weighted = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w"))
    ranged = materialize(weighted.repartitionByRange(parts, *keys, "x")
                         .withColumn("pid", F.spark_partition_id()))

    piece = Window.partitionBy(*keys, "pid").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("cum", F.sum("w").over(piece))

    totals = ranged.groupBy(*keys, "pid").agg(F.sum("w").alias("pw"))
    order = Window.partitionBy(*keys).orderBy("pid")
    offsets = (totals
               .withColumn("off", F.sum("pw").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("pw"))
               .withColumn("n", F.sum("pw").over(Window.partitionBy(*keys)))
               .drop("pw"))
    # Ungrouped: at most (partitions + columns) rows, a static bound -> broadcast.
    # Grouped: one row per (group, piece); AQE broadcasts it only when the
    # materialized size is under its threshold, else the join is shuffled.
    if not by and parts + len(cols) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    spans = (local.join(offsets, on=names + ["pid"])
             .withColumn("end", F.col("off") + F.col("cum"))
             .withColumn("start", F.col("end") - F.col("w")))

    pos = [(F.col("n") - F.lit(1)).cast("double") * F.lit(p) for p in probs]
    targets = F.array(*[F.floor(x) for x in pos], *[F.ceil(x) for x in pos])
    hits = spans.where(F.exists(targets, lambda t: (t >= F.col("start")) & (t < F.col("end"))))
    grouped = hits.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.collect_list(F.struct("start", "end", "x")).alias("segs"))
    rows = F.array(*[F.struct(F.lit(p).alias("p"), _interpolate(F.col("n"), F.col("segs"), p).alias("value"))
                     for p in probs])
    return grouped.select(*map(col_of, by), _names(cols).alias("column"), F.inline(rows))


def quantile_values(df: DataFrame, cols: str | Sequence[str], probs: Sequence[float],
                    approx: bool = False) -> dict[str, dict[float, float | None]]:
    """Ungrouped quantiles as a small driver-side dict {column: {p: value}} (bounded size)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    out: dict[str, dict[float, float | None]] = {c: {float(p): None for p in probs} for c in cols}
    for r in quantiles(df, cols, probs, approx=approx).collect():
        out[r["column"]][float(r["p"])] = r["value"]
    return out
