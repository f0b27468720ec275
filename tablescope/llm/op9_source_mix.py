"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to): one number of words per pattern. The flow network has one arc per
pattern and repetition - the first use of a pattern's words costs less than the
second, so costs are convex and words repeat only when fresh ones are used up -
an arc from each pattern to each of its sources, and each source's target as
its quota. The cheapest flow says how many words of each pattern each source
takes. Documents are then selected in a seeded hash order until the amounts are
reached.

Only the per-pattern sums reach the driver, bounded by ``max_patterns`` (an
error beyond it, never a cut). Selection is two-level: words per (pattern, hash
bucket) give the bucket where an amount ends (``bits_for`` cuts more buckets
from more documents), and only those buckets' documents are ranked; every other document is decided by comparing hashes, so a source
holding a third of all rows is spread over its buckets.

Defined results: a null text has size 0; a null source (or an empty membership)
is a source of its own, sorted last; equal (doc_id, source) rows are decided
together; a source whose words are all 0 gets target 0; an empty table gives an
empty result; extra columns are kept by ``apply_mix``.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import bounded_rows, pin, word_count

WEIGHTS, SHARE, REPEAT_COSTS, SEED, LEAST_BITS, BUCKET_ROWS, MAX_PATTERNS = (3, 1, 2), 1.5, (1, 3), 17, 12, 1 << 16, 10_000


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = float(len(REPEAT_COSTS))) -> dict:
    """source -> target words: ``share`` of all words by weight (the weights repeat
    over the sources by code point, null last); a target stops at ``most`` times
    its source's words and the excess is reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out, open_ = {}, [s for s in order]
    left = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def flow(patterns: dict, quotas: dict, repeat_costs=REPEAT_COSTS) -> dict:
    """{(pattern, repetition, source): words}: a maximum flow of least cost.

    ``patterns`` maps a tuple of sources to its words. Every path costs the
    repetition it uses, so the cheapest augmenting paths are those of the lowest
    repetition that still has one: blocking flows (level graphs) are pushed per
    repetition, in order of cost, over one residual network.
    """
    keys = list(patterns)
    node = {("p", p): i + 2 for i, p in enumerate(keys)}
    for s in quotas:
        node["s", s] = len(node) + 2
    graph: list[list[list]] = [[] for _ in range(len(node) + 2)]

    def arc(a: int, b: int, cap: int) -> list:
        there, back = [b, cap, None], [a, 0, None]
        there[2], back[2] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    through = {(p, s): arc(node["p", p], node["s", s], 1 << 62) for p in keys for s in p}
    for s, quota in quotas.items():
        arc(node["s", s], 1, int(quota))
    levels = sorted(range(len(repeat_costs)), key=lambda i: repeat_costs[i])
    for _ in levels:
        for p in keys:
            arc(0, node["p", p], int(patterns[p]))
        while True:
            depth = {0: 0}
            queue = deque([0])
            while queue:
                a = queue.popleft()
                for b, cap, _back in graph[a]:
                    if cap > 0 and b not in depth:
                        depth[b] = depth[a] + 1
                        queue.append(b)
            if 1 not in depth:
                break
            at = [0] * len(graph)
            while path := _path(graph, depth, at):
                push = min(e[1] for e in path)
                for e in path:
                    e[1] -= push
                    e[2][1] += push
    # a pattern's repetitions fill in order of cost, so its flow to each source is dealt over them in that order
    out = {}
    for p in keys:
        need = {s: through[p, s][2][1] for s in p}
        for level in levels:
            room = int(patterns[p])
            for s in p:
                give = min(room, need[s])
                if give:
                    out[p, level, s] = give
                    need[s] -= give
                    room -= give
    return out


def _path(graph, depth, at):
    """One augmenting path of the level graph, found without recursion."""
    path, a = [], 0
    while a != 1:
        while at[a] < len(graph[a]):
            e = graph[a][at[a]]
            if e[1] > 0 and depth.get(e[0]) == depth[a] + 1:
                break
            at[a] += 1
        else:
            if not path:
                return None
            path.pop()
            a = path[-1][0] if path else 0
            at[a] += 1
            continue
        path.append(e)
        a = e[0]
    return path


def _order(seed: int) -> Column:
    """63 hash bits: the seeded order in which documents are taken."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)


def bits_for(rows: int) -> int:
    """Bits of the hash that name a bucket: a bucket holds about BUCKET_ROWS documents
    at most, however many there are, so the ranked bucket does not grow with a source."""
    return max(LEAST_BITS, (max(0, rows - 1) // BUCKET_ROWS).bit_length())


def slim_rows(docs: DataFrame, members: Column, seed: int) -> DataFrame:
    """doc_id, members, pattern, size, h of every document."""
    sorted_members = F.array_sort(F.array_distinct(members))  # nulls last
    rows = docs.select("doc_id", F.when(F.size(sorted_members) > 0, sorted_members).otherwise(F.array(F.lit(None).cast("string"))).alias("members"),
                       word_count(F.col("text")).alias("size"), _order(seed).alias("h"))
    return rows.withColumn("pattern", F.to_json(F.struct(F.transform("members", lambda x: F.coalesce(F.concat(F.lit("+"), x), F.lit("-"))).alias("m"))))


def plan(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """``slim`` -> (parts, goals): how many words each repetition of each pattern
    gives each source, and each source's words and target. Bounded by patterns."""
    spark = slim.sparkSession
    sums = bounded_rows(slim.groupBy("pattern").agg(F.min("members").alias("members"), F.sum("size").alias("size")),
                        max_patterns, "membership patterns")
    by = {tuple(r["members"]): (r["pattern"], int(r["size"])) for r in sorted(sums, key=lambda r: r["pattern"])}
    sizes: dict = {}
    for p, (_, n) in by.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share)
    dealt = flow({p: n for p, (_, n) in by.items()}, {s: round(t) for s, t in goal.items()})
    steps = []
    for p, (key, n) in by.items():
        for level in range(len(REPEAT_COSTS)):
            upto, mine = 0, [s for s in p if dealt.get((p, level, s))]
            for seq, s in enumerate(mine):
                upto += dealt[p, level, s]
                steps.append((key, level, seq, s, upto, upto >= n, seq == len(mine) - 1))
    parts = spark.createDataFrame(steps, "pattern string, level int, seq int, member string, upto long, whole boolean, final boolean")
    goals = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], "source string, source_size long, target double")
    return parts, goals


def cuts(slim: DataFrame, parts: DataFrame, bucket_bits: int) -> DataFrame:
    """One row per pattern: the parts, each with its end position (h, doc_id).

    A part ends inside one hash bucket of its pattern. Only the documents of
    such buckets are ranked. Documents up to the end fit whole; of those after
    it in the bucket, the one whose size comes closest to what is left closes
    the last part, unless leaving the rest open is closer still.
    """
    slim = slim.withColumn("bucket", F.shiftright("h", 63 - bucket_bits))
    sums = slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("pattern").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("n").over(run) - F.col("n"))
    ends = (parts.where("not whole").join(sums, "pattern").where("before < upto and upto <= before + n")
            .select("pattern", "bucket", "level", "seq", "upto", "before"))
    docs = slim.join(F.broadcast(ends.select("pattern", "bucket").distinct()), ["pattern", "bucket"], "left_semi")
    docs = docs.groupBy("pattern", "bucket", "h", "doc_id").agg(F.sum("size").alias("size"))
    rank = Window.partitionBy("pattern", "level", "seq").orderBy("h", "doc_id")
    at = docs.join(ends, ["pattern", "bucket"]).withColumn("upto", F.col("upto") - F.col("before")).withColumn("to", F.sum("size").over(rank))
    fits, pos = F.col("to") <= F.col("upto"), F.struct("h", "doc_id")
    reached = Window.partitionBy("pattern", "level", "seq")
    at = at.withColumn("left", F.col("upto") - F.coalesce(F.max(F.when(fits, F.col("to"))).over(reached), F.lit(0)))
    end = at.groupBy("pattern", "level", "seq", "bucket", "left").agg(
        F.max(F.when(fits, pos)).alias("last"),
        F.min(F.when(~fits, F.struct(F.abs(F.col("size") - F.col("left")).alias("gap"), pos.alias("pos")))).alias("close"))
    floor = F.struct(F.shiftleft("bucket", 63 - bucket_bits).alias("h"), F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"))
    end = end.select("pattern", "level", "seq", F.coalesce("last", floor).alias("last"),
                     F.when(F.col("close.gap") < F.col("left"), F.col("close.pos")).alias("close"))
    full = parts.join(end, ["pattern", "level", "seq"], "left")
    earlier = Window.partitionBy("pattern", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("after", F.last("last", ignorenulls=True).over(earlier)).withColumn("close", F.when(F.col("final"), F.col("close")))
    return full.groupBy("pattern").agg(F.collect_list(F.struct("level", "member", "whole", "after", "last", "close")).alias("parts"))


def takes(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` (pattern, h, doc_id, ...) with ``takes``: one (level, member) per
    repetition of the document that the mix uses. The ends are one row per
    pattern, at most ``max_patterns`` of them, hence the broadcast."""
    pos = F.struct("h", "doc_id")
    mine = F.filter("parts", lambda x: ((x["whole"] | (pos <= x["last"])) & (x["after"].isNull() | (pos > x["after"])))
                    | F.coalesce(pos == x["close"], F.lit(False)))
    used = F.transform(mine, lambda x: F.struct(x["level"].alias("level"), x["member"].alias("member")))
    return (rows.join(F.broadcast(ends), "pattern", "left")
            .withColumn("takes", F.coalesce(used, F.array().cast("array<struct<level:int,member:string>>"))).drop("parts"))


def mix(docs: DataFrame, members: Column | None = None, seed: int = SEED, weights=WEIGHTS, share: float = SHARE,
        bucket_bits: int | None = None, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(rows, goals): slim rows with ``takes``, and source_size and target per source.

    ``members`` is an array<string> column of the sources a document belongs to;
    by default the one in its ``source`` column.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    slim = pin(slim_rows(docs, members, seed), "mix")
    parts, goals = plan(slim, weights, share, max_patterns)
    ends = pin(cuts(slim, parts, bits_for(slim.count()) if bucket_bits is None else bucket_bits), "mix-ends")
    return takes(slim, ends), goals


def mix_digest(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents of one source each."""
    rows, goals = mix(docs, seed=seed)
    source = F.element_at("members", 1)
    goals = F.broadcast(goals.withColumnRenamed("source", "_s"))
    return (rows.withColumn("source", source).join(goals, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("takes")).alias("taken"), "source"))


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix has them: each document as many times as it is taken,
    all columns kept. The ends are compared with each row's own hash: no join by id."""
    slim = pin(slim_rows(docs, F.array(F.col("source").cast("string")), seed), "mix")
    parts, _ = plan(slim)
    ends = pin(cuts(slim, parts, bits_for(slim.count())), "mix-ends")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"),
                        F.array(F.col("source").cast("string")).alias("m"))
    keyed = inner.select("_row", "doc_id", _order(seed).alias("h"), F.to_json(F.struct(F.transform(
        "m", lambda x: F.coalesce(F.concat(F.lit("+"), x), F.lit("-"))).alias("m"))).alias("pattern"))
    return takes(keyed, ends).select("_row", F.explode("takes")).select("_row.*")
