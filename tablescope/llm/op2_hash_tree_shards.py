"""Hierarchical weighted hash tree: region, rack and shard levels, each chosen by a weighted hash draw.

Every child of a tree node draws ``-ln(u) / weight`` from a uniform hash of
(key, child name); the smallest draw wins, so a child is chosen with probability
weight / (sum of weights) and its draw depends on nothing but the key, its own
name and its own weight. A node's weight is the sum of its shards' weights.
Changing weights below one node changes the draws on its path only: rows move
into or out of that subtree, never between two untouched ones. Native
expressions throughout; assigning a shard needs no shuffle.

Defined results: a null key is a key like any other (it hashes as an empty
string with its own mark); rows with equal keys share a shard; an empty table
gives an empty result; all columns of the input are kept (the shard columns get
the names asked for and replace columns of that name).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """One shard of the tree: its place and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: 16 equal shards: 2 regions of 2 racks of 4 shards.
SIXTEEN = tuple(Leaf(f"r{i // 8}", f"k{i // 4}", i) for i in range(16))


def grown(leaves: Iterable[Leaf], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard in a region of its own: no other draw
    changes at any level, so the new shard takes rows only into itself."""
    leaves = tuple(leaves)
    new = max(x.shard for x in leaves) + 1
    return (*leaves, Leaf(f"r+{new}", f"k+{new}", new, weight))


def _draw(key: Column, child: str, weight: float) -> Column:
    # 52 bits of a digest: exact in a double, and never 0, so the logarithm is finite
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(child))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def _choose(key: Column, level: str, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw (ties: the earlier name)."""
    live = sorted((c for c in children if c[1] > 0), key=lambda c: c[0])
    if not live:
        raise ValueError("a tree needs a positive weight below every node")
    if len(live) == 1:
        return live[0][2]
    draws = F.array(*[F.struct(_draw(key, f"{level}:{n}", w).alias("d"), F.lit(i).alias("i"))
                      for i, (n, w, _) in enumerate(live)])
    # the winner's position is bound once by the one-element transform
    pick = F.transform(F.array(F.array_min(draws)["i"]), lambda i: _case(i, [v for _, _, v in live]))
    return F.element_at(pick, 1)


def _case(i: Column, values: list[Column]) -> Column:
    out = F.when(i == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(i == k, v)
    return out


def shard_of(key: Column, leaves: Iterable[Leaf]) -> Column:
    """The shard number (int) of a text key: three draws, one per level."""
    leaves = list(leaves)
    key = F.coalesce(key, F.lit("\x00null"))

    def racks(region: str) -> Column:
        own = [x for x in leaves if x.region == region]
        names = sorted({x.rack for x in own})
        return _choose(key, f"rack:{region}", [(r, sum(x.weight for x in own if x.rack == r), shards(region, r)) for r in names])

    def shards(region: str, rack: str) -> Column:
        own = [x for x in leaves if (x.region, x.rack) == (region, rack)]
        return _choose(key, f"shard:{region}/{rack}", [(str(x.shard), x.weight, F.lit(x.shard)) for x in own])

    regions = sorted({x.region for x in leaves})
    return _choose(key, "region", [(r, sum(x.weight for x in leaves if x.region == r), racks(r)) for r in regions]).cast("int")


def assign(df: DataFrame, key: str, leaves: Iterable[Leaf] = SIXTEEN, out: str = "shard") -> DataFrame:
    """``df`` with its shard; a projection, so rows stay where they are."""
    return df.withColumn(out, shard_of(F.col(f"`{key}`").cast("string"), leaves))


def number_slots(df: DataFrame, shard: str, order: list[str], buckets: int = 1024, piece: int = 100_000) -> DataFrame:
    """Gapless slots from 0 in each shard for the distinct ``(shard, *order)`` of ``df``.

    Rows that agree in all these columns are counted first (map-side), so a key
    repeated by a third of all rows is one counted row. Each shard is cut in
    ``buckets`` hash buckets (crc32 of the values as text, joined by ``/``); bucket sizes (shards x buckets rows) give each
    bucket its first slot, and only inside a bucket are rows ranked. Counted
    rows are then unrolled, ``piece`` at a time. Returns shard, order..., slot.
    """
    cols = [shard, *order]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_b", F.pmod(F.crc32(F.concat_ws("/", *[F.col(c).cast("string") for c in order])), F.lit(buckets)).cast("int"))
    from pyspark.sql import Window
    sizes = counted.groupBy(shard, "_b").agg(F.sum("_n").alias("_size"))
    first = sizes.select(shard, "_b", (F.sum("_size").over(Window.partitionBy(shard).orderBy("_b")) - F.col("_size")).alias("_first"))
    rank = Window.partitionBy(shard, "_b").orderBy(*order)
    ranked = (counted.withColumn("_at", F.sum("_n").over(rank) - F.col("_n"))
              .join(first, [shard, "_b"]).withColumn("_from", F.col("_first") + F.col("_at")))
    pieces = ranked.select(*cols, "_from", "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {piece})")).alias("_p"))
    return pieces.select(*cols, F.explode(F.expr(
        f"sequence(_from + _p * {piece}, _from + least(_n, (_p + 1) * {piece}) - 1)")).alias("slot"))


def shard_documents(docs: DataFrame, leaves: Iterable[Leaf] = SIXTEEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of the sharded table: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1); ``text_crc32`` is
    null for a null text; law ``key``: the shard depends on doc_id and the tree
    alone. One row per input row; repeated rows get slots of their own.
    """
    leaves = tuple(leaves)
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    slim = docs.select(k.alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
                       F.crc32(t).alias("text_crc32"))
    placed = slim.withColumn("shard", shard_of(k.cast("string"), leaves)) if key == "doc_id" else assign(slim, "doc_id", leaves)
    slots = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                        shard_of(F.col("doc_id").cast("string"), grown(leaves)).alias("grown_shard"))
