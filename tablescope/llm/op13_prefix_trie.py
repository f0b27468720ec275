"""Prefix trie of conversations: which first turns they share, and what sharing saves.

A prefix is known by a 128-bit digest, the xor of a hash of each of its turns with
its place, so digests of all prefixes are running totals. A count-min sketch of the
digests screens them: an estimate of one proves that a single conversation has the
prefix, so it and all longer ones are nodes of that conversation alone, which emits
them where it stands. Only prefixes that may be shared are shuffled and grouped.

Sums over subtrees need no walk by depth. The smallest member of a node is also the
smallest member of every deeper node on its own path, so each node's amount is booked
on the path of its smallest member, summed from the path's end, and the sums at one
prefix are added over all members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import pin
from tablescope.llm.running import running

#: Turns that a conversation may take over, and how many conversations share one to take from.
HEAD, FAMILY = 6, 100
ROWS = 3
BLOCK = 1 << 16
#: Cells of a row of the sketch: twice the prefixes, up to this. Beyond it more prefixes
#: look shared and are shuffled; the result is the same.
MAX_CELLS = 1 << 26
#: Ids of one piece of a node's list of ends.
PIECE = 4096


def ordered_turns(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, turn, role, text)`` -> (conv_id, rank, n, t1, t2, chars)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.xxhash64(F.lit(k), role, text).alias(f"t{k}") for k in (1, 2)],
        F.char_length(text).cast("long").alias("chars"))
    return pin(running(pin(slim, "turns"), "conv_id", ["turn", "t1", "t2"], "turn-order").drop("turn"), "turn-ranks")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv_id, length), their turns (conv_id, at, t1, t2, chars, length)):
    the first turns of the family's first conversation in place of as many own ones."""
    own = turns.where("rank = 0").select("conv_id", "n").withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int"))
    heads = (turns.where((F.col("rank") < HEAD - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("first"))
             .agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("at"), "t1", "t2", "chars"))).alias("head")))
    convs = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "first", "left")
    convs = convs.withColumn("head", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(array(named_struct('at', 0L, 't1', 0L, 't2', 0L, 'chars', 0L)), 1, 0)")))
    convs = pin(convs.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    taken = convs.select("conv_id", "length", F.explode("head").alias("x")).select("conv_id", "x.at", "x.t1", "x.t2", "x.chars", "length")
    rest = (turns.join(convs.select("conv_id", "length", "h", F.size("head").alias("given")), "conv_id").where("rank >= h")
            .select("conv_id", (F.col("rank") - F.col("h") + F.col("given")).alias("at"), "t1", "t2", "chars", "length"))
    return convs.select("conv_id", "length"), pin(taken.unionByName(rest), "rebuilt")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, d1, d2, p1, p2, chars, length): each prefix's digest and its parent's,
    sorted by conversation and depth inside each task."""
    lanes = turns.select("conv_id", "at", "chars", "length", *[F.xxhash64(F.lit(k), "at", "t1", "t2").alias(f"x{k}") for k in (1, 2)])
    run = running(lanes, "conv_id", ["at"], "prefix-order", xors=["x1", "x2"])
    return run.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("x1_run").alias("d1"), F.col("x2_run").alias("d2"),
                      *[F.col(f"x{k}_run").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)], "chars", "length")


def _cells(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    d1, d2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("d1", "d2"))
    with np.errstate(over="ignore"):
        return [((d1 + np.uint64(i) * (d2 | np.uint64(1))) & np.uint64(width - 1)).astype(np.int64) for i in range(ROWS)]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Count-min counters of ``rows(d1, d2)`` that stop at two, two bits a cell, four
    cells a byte. Tasks send the cells that they touch, no more than rows; each block
    of counters is added up by itself; the driver gets ROWS * width / 4 bytes."""
    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, cells = [], []
            for i, at in enumerate(_cells(batch, width)):
                cell, n = np.unique(at + i * width, return_counts=True)
                coded = (cell % BLOCK).astype(np.uint32) | ((n > 1).astype(np.uint32) << 31)
                home = cell // BLOCK
                for start, end in zip(s := np.flatnonzero(np.r_[True, home[1:] != home[:-1]]), [*s[1:], len(home)], strict=True):
                    block.append(int(home[start]))
                    cells.append(coded[start:end].tobytes())
            yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "cells": pa.array(cells, pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(block, count):
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "cells": pa.array([np.bitwise_or.reduce(
                count.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1).astype(np.uint8).tobytes()], pa.binary())})
        now, count = None, None
        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield packed(now, count)
                    now, count = block, np.zeros(BLOCK, np.uint8)
                coded = np.frombuffer(cells, np.uint32)
                at = coded & np.uint32(0x7FFFFFFF)
                count[at] = np.minimum(count[at] + 1 + (coded >> 31), 2).astype(np.uint8)
        if now is not None:
            yield packed(now, count)

    parts = (rows.select("d1", "d2").mapInArrow(touched, "block long, cells binary").repartition("block")
             .sortWithinPartitions("block").mapInArrow(added, "block long, cells binary"))
    out = np.zeros(ROWS * width // 4, np.uint8)
    for row in parts.toLocalIterator():
        out[row.block * BLOCK // 4:(row.block + 1) * BLOCK // 4] = np.frombuffer(row.cells, np.uint8)
    return out


def screened(rows: DataFrame, counters: np.ndarray, width: int) -> DataFrame:
    """``rows`` with ``alone``: the estimate of this prefix, or of a shorter one just
    before it in the same task, is one; ``leads``: the row before it is not alone."""
    held = rows.sparkSession.sparkContext.broadcast(counters)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, was = held.value, (None, 0), False  # conversation and depth of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            least = np.full(batch.num_rows, 3, np.uint8)
            for i, at in enumerate(_cells(batch, width)):
                at = at + i * width
                least = np.minimum(least, (table[at >> 2] >> (2 * (at & 3)).astype(np.uint8)) & 3)
            conv, depth = (batch.column(c).to_numpy() for c in ("conv_id", "depth"))
            starts = np.r_[(conv[0], depth[0] - 1) != last, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)]
            single = least == 1
            single[0] |= was and not starts[0]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(conv)), 0))
            seen = np.cumsum(single)
            alone = seen - (seen - single)[first] > 0
            before = np.r_[was, alone[:-1]] & ~starts
            last, was = (conv[-1], depth[-1]), bool(alone[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(alone & ~before)], names=[*batch.schema.names, "alone", "leads"])

    return rows.mapInArrow(mark, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", alone boolean, leads boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """``rows(depth, d1, d2, conv_id)`` -> (depth, d1, d2, ends_sha256): ids ascending,
    joined by commas. Ids are ranked by pieces and joined to texts of PIECE ids; the
    hash, sequential by nature, reads a node's texts one after the other."""
    keyed = rows.withColumn("key", F.concat_ws(",", "depth", "d1", "d2"))
    ranked = running(pin(keyed.select("key", "conv_id"), "ends"), "key", ["conv_id"], "end-order")
    pieces = (ranked.groupBy("key", F.expr(f"rank div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
              .select("key", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, state):
            return pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
        now, state = None, None
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield out(now, state)
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            yield out(now, state)

    digests = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(hashed, "key string, ends_sha256 string")
    part = F.split("key", ",")
    return digests.select(*[part[i].cast("long").alias(c) for i, c in enumerate(KEY)], "ends_sha256")


KEY = ["depth", "d1", "d2"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``convs(conv_id, turn, role, text, ...)`` -> one row per node: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    Turns go by ``turn``, null first; turns that tie by a hash of role and text, and
    repeated rows are turns of their own. Null roles and texts are empty. Rows with a
    null conv_id belong to no conversation and are left out. Extra columns are not
    read. An empty table has no member for a root and gives an empty result.
    """
    all_convs, turns = rebuilt(ordered_turns(convs))
    count = turns.count()
    width = min(max_cells, max(BLOCK, 1 << (2 * max(1, count) - 1).bit_length()))
    every = pin(prefixes(turns), "prefixes")
    # the same order as written: conversation, then depth, inside each file
    marked = pin(screened(every, sketch(every, width), width), "screened")
    shared = marked.where("not alone")

    nodes = pin(shared.groupBy(*KEY, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends")), "nodes")
    booked = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
                          (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    amounts = (shared.select("conv_id", *KEY).join(booked, ["conv_id", "depth"], "left")
               .select("conv_id", *KEY, F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.lit(True).alias("node"))
               .unionByName(marked.where("alone and depth = length")
                            .select("conv_id", *KEY, F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"), F.lit(False).alias("node"))))
    amounts = pin(amounts.withColumn("down", -F.col("depth")), "amounts")
    sums = (running(amounts, "conv_id", ["down"], "amount-order", sums=["saved", "leaf"]).where("node")
            .groupBy(*KEY).agg(F.sum("saved_run").alias("saved_tokens"), F.sum("leaf_run").alias("n_leaves")))

    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    total = amounts.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")).first()
    root = (all_convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .withColumn("saved_tokens", F.lit(total.saved or 0).cast("long")).withColumn("n_leaves", F.lit(max(total.leaves or 0, 1)).cast("long"))
            .select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", "saved_tokens", "n_leaves"))
    inner = nodes.drop("chars", "n_ends").join(sums, KEY).unionByName(root)

    leads = marked.where("leads")
    born = (nodes.select("depth", "p1", "p2").unionByName(leads.select("depth", "p1", "p2"))
            .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children")))
    ends = _ends(shared.where("depth = length").select(*KEY, "conv_id")
                 .unionByName(all_convs.where("length = 0").select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "conv_id")))
    inner = pin(inner.join(born, KEY, "left").join(ends, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
                .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "inner-nodes")

    # A prefix whose parent is no shared node hangs on a node of its own conversation.
    parents = inner.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"))
    upper = (inner.join(parents, ["depth", "p1", "p2"], "left")
             .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))).select(NODE))
    last = F.col("depth") == F.col("length")
    tails = (leads.join(parents, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent", "conv_id")).select(*leads.columns, "parent_conv_id")
             .unionByName(marked.where("alone and not leads").withColumn("parent_conv_id", F.col("conv_id")))
             .select("conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), F.when(last, zero).otherwise(1).cast("long").alias("n_children"),
                     F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
                     F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256")))
    return upper.unionByName(tails).withColumn("depth", F.col("depth").cast("long"))
