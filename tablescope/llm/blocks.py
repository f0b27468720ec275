"""Comparing the rows of a bucket in blocks, so that no task holds a whole bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = ["bucket", "first", "second"]


def block_units(rows: DataFrame, block: int, spread_by: str) -> DataFrame:
    """``rows(bucket long, ...)`` -> the rows of buckets of two or more, dealt to
    units (bucket, first, second): a bucket of m rows is cut in ceil(m / block)
    sides, and each pair of sides is one unit. Sorted by unit within partitions."""
    sizes = rows.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).cast("int").alias("_sides"))
    out = rows.join(sizes, "bucket").withColumn("side", F.pmod(F.xxhash64(spread_by, "bucket"), F.col("_sides")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_sides") - 1)))
    return (out.withColumn("first", F.least("side", "_other")).withColumn("second", F.greatest("side", "_other"))
            .drop("_other", "_sides").repartition(*UNIT).sortWithinPartitions(*UNIT))


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, left, right) of each unit of two rows or more; left is right inside one block."""
    def sides(t: pa.Table):
        side = t.column("side").to_numpy()
        if t.column("first")[0].as_py() == t.column("second")[0].as_py():
            every = np.arange(len(side))
            return t.combine_chunks(), every, every
        return t.combine_chunks(), np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in UNIT])
        start = 0
        for end in np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1:
            if end - start > 1:
                yield sides(t.slice(start, end - start))
            start = end
        held = t.slice(start)
    if held is not None and len(held) > 1:
        yield sides(held)
