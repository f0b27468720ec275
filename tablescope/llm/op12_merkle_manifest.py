"""Merkle manifest: one tree of digests per source, one over the sources' roots.

A node is labelled by the interval [lo, hi) of leaf ranks that it covers. Levels are
taken in bands of three: a band's block holds the nodes of its levels as arrays, so
one shuffle builds three levels, and blocks are rows of at most 27 lowest nodes.
Going down again, nodes meet the block whose interval contains theirs (joined by
source and by lo div the block's width). In it, the node of each level that contains
the rank is the ancestor; the siblings are what the parent's interval holds beside
the ancestor's own. No join key has more than 27 rows on its larger side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import pin
from tablescope.llm.running import running

#: Three nodes make one.
ARITY = 3
BAND = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODE = "array<struct<lo:bigint,hi:bigint,digest:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each with its byte count before it, ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _height(n: str) -> Column:
    """Levels above ``n`` leaves: powers of three below n."""
    return F.size(F.filter(F.array(*[F.lit(ARITY ** k) for k in range(40)]), lambda p: p < F.col(n)))


def _up(nodes: str) -> Column:
    """The parents of an array of neighbouring nodes that starts at a run's first."""
    run = f"slice({nodes}, {ARITY} * i + 1, {ARITY})"
    return F.expr(f"""transform(sequence(0, cast((size({nodes}) - 1) div {ARITY} as int)), i -> named_struct(
        'lo', {nodes}[{ARITY} * i].lo, 'hi', element_at({run}, -1).hi,
        'digest', sha2(array_join(transform({run}, x -> x.digest), ''), 256)))""")


def _span(band: int) -> int:
    return ARITY ** (BAND * (band + 1))


def _blocks(nodes: DataFrame, band: int) -> DataFrame:
    """``nodes(grp, n, lo, hi, digest)`` of one level -> (grp, n, bucket, lo, hi, levels, l0 .. l3, digest)."""
    out = (nodes.groupBy("grp", "n", F.expr(f"lo div {_span(band)}").alias("bucket"))
           .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).cast(_NODE).alias("l0"))
           .withColumn("levels", F.least(F.greatest(_height("n") - BAND * band, F.lit(0)), F.lit(BAND))))
    for j in range(BAND):
        out = out.withColumn(f"l{j + 1}", F.when(F.col("levels") > j, _up(f"l{j}")).otherwise(F.col(f"l{j}")))
    top = F.col(f"l{BAND}")[0]
    return out.select("*", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"))


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """``leaves(grp, n, rank, digest)`` -> written blocks, lowest band first; those of
    the last band are one per group and carry its root as ``digest``."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    nodes = leaves.select("grp", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    bands = [pin(_blocks(nodes, 0), f"{name}-0")]
    while _span(len(bands) - 1) < most:
        bands.append(pin(_blocks(bands[-1].select("grp", "n", "lo", "hi", "digest"), len(bands)), f"{name}-{len(bands)}"))
    return bands


def _attach(nodes: DataFrame, blocks: DataFrame, band: int, carried: list[str]) -> DataFrame:
    """``nodes(grp, lo, hi, ...)`` with ``steps``: those inside the block that contains
    the node, then the block's own. ``blocks`` has ``above`` and the ``carried`` columns."""
    b = blocks.select("grp", "bucket", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "levels", "above", *[f"l{j}" for j in range(BAND + 1)], *carried)
    met = (nodes.withColumn("bucket", F.expr(f"lo div {_span(band)}")).join(b, ["grp", "bucket"])
           .where((F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))))
    for j in range(BAND + 1):
        met = met.withColumn(f"a{j}", F.expr(f"filter(l{j}, x -> x.lo <= lo and lo < x.hi)[0]"))
    steps = []
    for j in range(BAND):
        left = f"filter(l{j}, x -> x.lo >= a{j + 1}.lo and x.hi <= a{j}.lo)"
        right = f"filter(l{j}, x -> x.lo >= a{j}.hi and x.hi <= a{j + 1}.hi)"
        join = "array_join(transform({}, x -> x.digest), '')"
        steps.append(F.expr(f"named_struct('left', {join.format(left)}, 'right', {join.format(right)})"))
    own = F.slice(F.array(*steps), F.lit(1), F.col("levels"))
    return met.select(*nodes.columns, F.concat(own, F.col("above")).alias("steps"), *carried)


def attach(leaves: DataFrame, bands: list[DataFrame], roots: DataFrame, carried: list[str]) -> DataFrame:
    """``leaves(grp, lo, hi, ...)`` with the steps from leaf to root and the ``carried``
    columns of ``roots(grp, above, ...)``, where ``above`` are the steps beyond the root."""
    known = bands[-1].join(roots, "grp")
    for band in range(len(bands) - 1, 0, -1):
        below = bands[band - 1]
        tops = _attach(below.select("grp", "lo", "hi"), known, band, carried)
        known = below.join(tops.select("grp", F.col("lo").alias("_top"), F.col("steps").alias("above"), *carried),
                           (below.grp == tops.grp) & (below.lo == F.col("_top"))).select(below["*"], "above", *carried)
    return _attach(leaves, known, 0, carried)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf digest and the steps of its proof lead to."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """``docs(doc_id, source, lang, n_chars, text, ...)`` -> per row: doc_id, source,
    leaf, subroot (of its source), root (of all), steps (the proof: per level the
    siblings' digests on the left and on the right, each as one text, from leaf to
    root) and found_leaf (of the text as found now: ``found_text``, an expression
    over ``docs``; as given if None).

    Leaves of a source ascend by doc_id, null first; rows of one id by their digest,
    and identical rows are leaves of their own beside each other. The null source is a
    source. Any field may be null; extra columns are not read. An empty table gives an
    empty result, without a root.
    """
    fields = [F.col(c) for c in FIELDS]
    found = fields[:-1] + [F.col("text") if found_text is None else found_text]
    slim = pin(docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp"),
                           leaf_digest(fields).alias("leaf"), leaf_digest(found).alias("found_leaf")), "leaves")
    leaves = pin(running(slim, "grp", ["doc_id", "leaf"], "leaf-order"), "leaf-ranks")
    bands = build(leaves.select("grp", "n", "rank", F.col("leaf").alias("digest")), "bands")
    # grp without its mark sorts like the source, the null source ("") first
    subroots = pin(bands[-1].select(F.lit("all").alias("grp"), F.col("grp").alias("of"), F.col("digest").alias("subroot")), "subroots")
    subroots = pin(running(subroots, "grp", ["of"], "subroot-order"), "subroot-ranks")
    tops = build(subroots.select("grp", "n", "rank", F.col("subroot").alias("digest")), "top-bands")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    total = tops[-1].select("grp", nothing.alias("above"), F.col("digest").alias("root"))
    over = attach(subroots.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "of", "subroot"), tops, total, ["root"])
    roots = over.select(F.col("of").alias("grp"), F.col("steps").alias("above"), "subroot", "root")
    placed = leaves.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "doc_id", "source", "leaf", "found_leaf")
    return attach(placed, bands, roots, ["subroot", "root"]).select("doc_id", "source", "leaf", "subroot", "root", "steps", "found_leaf")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest, each proof as a digest, and its check against texts that lost
    their line ends where 2 divides the crc32 of the id (a null id's text stays)."""
    bent = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = F.when(bent, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = manifest(docs, found)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.col("found_leaf"), F.col("steps"))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
                    (folded == F.col("root")).alias("verified"))
