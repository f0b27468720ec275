"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine check, connected components.

Each vector gets ``tables`` codes of ``bits`` signs against seeded hyperplanes.
Vectors that share (label, dimension, table, code) meet in a bucket and are
compared by exact cosine in double precision, in blocks of ``block`` vectors: a
bucket of any size is cut in blocks and every pair of blocks is its own unit of
work, so no task holds a bucket. A pair that meets in several tables counts only
in the first one, which the codes of both show. Tasks return sums, never pairs:
the number of links of each vector, and edges that span each unit's connected
groups; components then join over all units.

At cosine 0.98 two signs differ with probability acos(0.98)/pi = 0.064, so one
table of 12 bits finds the pair with probability 0.45 and 24 tables miss it
with 6e-7. No pair below the limit is ever linked.

Equal vectors are one class and are compared once; their counts are weights.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing (n_links 0, own
component); vectors of different length are never linked; repeated vec_ids keep
a row each and count as vectors of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import pin
from tablescope.llm.components import components

LIMIT, BITS, TABLES, BLOCK, SEED = 0.98, 12, 24, 512, 29


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(n, tables) integer codes."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables, seed) > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is divided by its largest component first, so that no
    square over- or underflows, whatever finite numbers other than all zeros it holds."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _hashed(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat = batch.column("rep"), batch.column("embedding")
            lengths = np.diff(flat.offsets.to_numpy())
            values = flat.values.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = flat.offsets.to_numpy()[:-1]
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                vectors = unit_vectors(values[starts[rows][:, None] + np.arange(dim)])
                codes = sign_codes(vectors, bits, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), batch.column("label_key").take(pa.array(rows)), batch.column("n").take(pa.array(rows)),
                     pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["rep", "label_key", "n", "vector", "codes"])
    return run


def _compared(limit: float):
    """Rows sorted by (bucket, pair of blocks) -> link counts and spanning edges of each unit."""
    def unit(rows: dict, out: list) -> None:
        rep, table = rows["rep"], int(rows["table"][0])
        norm = np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(len(rep), -1)
        codes, n, side = np.stack(rows["codes"]), np.asarray(rows["n"]), np.asarray(rows["side"])
        cross = side.min() != side.max()
        a = np.flatnonzero(side == side.min()) if rows["first"][0] != rows["second"][0] else np.arange(len(rep))
        b = np.flatnonzero(side == side.max()) if rows["first"][0] != rows["second"][0] else a
        if rows["first"][0] != rows["second"][0] and not cross:
            return
        near = norm[a] @ norm[b].T >= limit
        for t in range(table):  # pairs that already met in an earlier table
            near &= codes[a, t][:, None] != codes[b, t][None, :]
        if b is a:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, a, near @ n[b])
        if b is not a:
            np.add.at(links, b, near.T @ n[a])
        root = np.arange(len(rep))
        while True:  # smallest row reachable inside the unit
            low = root.copy()
            low[a] = np.minimum(low[a], np.where(near, root[b][None, :], len(rep)).min(1))
            low[b] = np.minimum(low[b], np.where(near, root[a][:, None], len(rep)).min(0))
            low = low[low]
            if (low == root).all():
                break
            root = low
        for i in np.flatnonzero(links):
            out.append((rep[i], int(links[i]), rep[root[i]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        out: list = []
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() if c == "vector" else
                    (list(batch.column(c).values.to_numpy().reshape(batch.num_rows, -1)) if c == "codes" else batch.column(c).to_numpy(zero_copy_only=False))
                    for c in batch.schema.names}
            cols = {c: list(v) for c, v in cols.items()}
            if held:
                cols = {c: held[c] + v for c, v in cols.items()}
            key = np.array([cols["bucket"], cols["first"], cols["second"]])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            start = 0
            for end in ends:
                if end - start > 1:
                    unit({c: v[start:end] for c, v in cols.items()}, out)
                start = end
            held = {c: v[start:] for c, v in cols.items()}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["rep", "links", "root"])
                out.clear()
        if held and len(held["rep"]) > 1:
            unit(held, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["rep", "links", "root"])
    return run


def near_vectors(vectors: DataFrame, limit: float = LIMIT, bits: int = BITS, tables: int = TABLES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> vec_id, n_links, component_id, kept, n_copies."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64("label").alias("label_key"),
                          F.col("label").isNotNull().alias("labelled"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    live = F.coalesce(F.col("labelled") & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("live", live)
    # a class of equal vectors is named by its smallest id
    classes = rows.where("live").groupBy("label_key", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = pin(classes, "vector-classes")
    hashed = classes.select("rep", "label_key", "n", "embedding").mapInArrow(
        _hashed(bits, tables, seed), "rep long, label_key long, n long, vector binary, codes array<long>")
    keyed = hashed.select("*", F.posexplode("codes").alias("table", "code"))
    keyed = keyed.withColumn("bucket", F.xxhash64("label_key", F.octet_length("vector"), "table", "code")).drop("code", "label_key")
    sizes = keyed.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    units = keyed.join(sizes, "bucket").withColumn("side", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    units = units.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = (units.withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other"))
             .drop("other", "blocks").repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second"))
    found = pin(units.mapInArrow(_compared(limit), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (classes.join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
             .select("label_key", "embedding", F.col("n").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = (rows.where("live").join(named, ["label_key", "embedding"])
           .select("vec_id", "n_links", "component_id", "n_copies")
           .unionByName(rows.where("not live").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                                      F.lit(1).cast("long").alias("n_copies"))))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_copies")
