"""Places and running totals inside groups of any size, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import pin


def running(rows: DataFrame, group: str, order: Sequence, name: str, xors: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank`` (place in its group by ``order``, from 0), ``n`` (rows of
    the group) and, for each column named in ``xors`` and ``sums``, ``<column>_run``:
    its total over the group's rows up to this one.

    The rows are dealt by range of (group, order), so a group of any size spans as
    many pieces as it needs, and are written in that order. Each piece counts by
    itself; totals of earlier pieces of the group, one row per piece and group, are
    added by a join. ``group`` must not be null. Rows that tie in ``order`` are
    ranked as they stand in ``rows``, which must therefore be read from files.
    """
    keys = [group, *order, "_tie"]
    placed = pin(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    totals = [F.count(F.lit(1)).alias("_n")] + [F.bit_xor(c).alias(f"_{c}") for c in xors] + [F.sum(c).alias(f"_{c}") for c in sums]
    earlier = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(group, "_piece").agg(*totals).select(
        group, "_piece", F.sum("_n").over(Window.partitionBy(group)).alias("n"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.bit_xor(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in xors],
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    here = Window.partitionBy(group, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(pieces, [group, "_piece"]).select(
        *rows.columns, "n", (F.col("_before") + F.count(F.lit(1)).over(here) - 1).alias("rank"),
        *[F.col(f"_{c}").bitwiseXOR(F.bit_xor(c).over(here)).alias(f"{c}_run") for c in xors],
        *[(F.col(f"_{c}") + F.sum(c).over(here)).alias(f"{c}_run") for c in sums])
