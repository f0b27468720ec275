"""The shard of every key and the documents of a mix, recomputed one after the other in plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tablescope.llm import op2_hash_tree_shards as o2, op9_source_mix as o9

DOCS = "doc_id long, text string, source string"


def draw(key, child, weight):
    bits = int(hashlib.md5(f"{key}/{child}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / 2**52) / weight


def shard(key, leaves):
    """Descends region, rack and shard: the smallest draw of each level's children wins."""
    def pick(level, weights):
        return next(iter(weights)) if len(weights) == 1 else min(sorted(weights), key=lambda n: draw(key, f"{level}:{n}", weights[n]))

    def weights(name, found):
        out = {}
        for x in found:
            out[str(getattr(x, name))] = out.get(str(getattr(x, name)), 0) + x.weight
        return {n: w for n, w in out.items() if w > 0}
    region = pick("region", weights("region", leaves))
    leaves = [x for x in leaves if x.region == region]
    rack = pick(f"rack:{region}", weights("rack", leaves))
    return int(pick(f"shard:{region}/{rack}", weights("shard", [x for x in leaves if x.rack == rack])))


UNEVEN = (o2.Leaf("eu", "a", 0, 2.0), o2.Leaf("eu", "a", 1, 0.5), o2.Leaf("eu", "b", 2, 1.0), o2.Leaf("us", "a", 3, 4.0), o2.Leaf("us", "a", 4, 0.0), o2.Leaf("us", "c", 5, 1.5))


@pytest.mark.parametrize("leaves", [o2.SIXTEEN, o2.grown(o2.SIXTEEN), UNEVEN, UNEVEN[:1]])
def test_shards_equal_plain_python(spark, leaves):
    keys = [str(i) for i in range(600)] + ["", "ключ", "a/b", None]
    df = spark.createDataFrame([(k, 1) for k in keys], "k string, shard int")
    got = {r.k: r.shard for r in o2.assign(df, "k", leaves).collect()}
    assert got == {k: shard("\x00null" if k is None else k, leaves) for k in keys}
    assert all(x.shard not in got.values() for x in leaves if x.weight == 0)


def test_null_ids_and_repeated_rows_have_shards_and_slots(spark):
    rows = [(None, "a"), (None, "a"), (None, None), (3, "a"), (3, "a"), (3, "b"), (4, None)] + [(i, "x") for i in range(5, 200)]
    got = o2.shard_documents(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, slot int")).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), len(t or "") + 1) for i, t in rows)
    for r in got:
        key = "\x00null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (shard(key, o2.SIXTEEN), shard(key, o2.grown(o2.SIXTEEN)))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def chosen(rows, goal, bits):
    """(level -> ids taken) of one source: its documents in hash order, up to the amount of each repetition."""
    total, out = sum(n for _, _, n in rows), {}
    for level, amount in enumerate((min(total, round(goal)), max(0, round(goal) - total))):
        if amount >= total and total:
            out[level] = {i for _, i, _ in rows}
            continue
        if not amount:
            continue
        upto, last, within = 0, None, []
        for h, i, n in sorted(rows):  # equal ids stand as one row of their summed size
            b, before = h >> (63 - bits), sum(m for g, _, m in rows if g >> (63 - bits) < h >> (63 - bits))
            inside = sum(m for g, _, m in rows if g >> (63 - bits) == b)
            if before < amount <= before + inside:
                within.append((h, i, n))
            elif before + inside < amount:
                upto += n
                last = (h, i)
        left, closest = amount - upto, None
        past = []
        for h, i, n in within:
            upto += n
            if upto <= amount:
                last, left = (h, i), amount - upto
            else:
                past.append((abs(n), h, i))
        if past:
            gap, h, i = min((abs(n - left), h, i) for n, h, i in past)
            closest = (h, i) if gap < left else None
        out[level] = {i for h, i, _ in rows if (last is not None and (h, i) <= last) or (h, i) == closest}
    return out


@pytest.mark.parametrize("bits", [None, 2, 0])
def test_mix_equals_plain_python(spark, bits):
    rows = [(i, "w " * (i * i % 37), ["s0", "s1", "s2", None][i % 4 if i % 3 else 0]) for i in range(300)]
    rows += [(400, None, "s1"), (401, "", "s1"), (402, "w " * 500, "s2"), (403, "w", "tiny"), (404, "", "none")] + [(500, "same text", "s0")] * 5
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", pattern int")
    slim, goals = o9.mix(df, bucket_bits=bits)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", o9._order(o9.SEED).alias("h")).collect()}
    sizes, by = {}, {}
    for i, t, s in rows:
        n = len(re.findall("[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        by.setdefault(s, {})
        by[s][i] = by[s].get(i, 0) + n
    goal = o9.targets(sizes)
    assert {r.source: (r.source_size, r.target) for r in goals.collect()} == {s: (sizes[s], goal[s]) for s in sizes}
    taken = {}
    for r in slim.select("doc_id", F.element_at("members", 1).alias("source"), F.explode("takes").alias("t")).select("doc_id", "source", "t.*").distinct().collect():
        assert r.member == r.source
        taken.setdefault((r.source, r.level), set()).add(r.doc_id)
    want = {(s, level): ids for s in by for level, ids in chosen([(hashes[i], i, n) for i, n in by[s].items()], goal[s], 12 if bits is None else bits).items() if ids}
    assert taken == want


def test_buckets_follow_the_rows():
    assert o9.bits_for(0) == o9.bits_for(10**6) == o9.LEAST_BITS
    assert all(n / 2 ** o9.bits_for(n) <= o9.BUCKET_ROWS for n in (10**9, 10**10, 10**13))
