"""Chat formatting of reply trees: root-to-leaf paths by self-joins, ranked, one conversation per chosen path.

Ancestors are found by path doubling: round ``i`` joins the table of ``2**i``-step
ancestors with itself, so a thread of depth d needs about log2(d) self-joins
whatever its size, and every join is on the unique (tree, node) - no key is hot.
The same rounds carry sums of scores to the root, so leaves are ranked before any
path is written out; only chosen paths are enumerated, doubling again from the
largest step down, which makes rows in proportion to the paths' lengths.
Native expressions throughout.

Template (fixed strings): ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.
Escaping: inside a text every control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) gets one backslash after its
first character, also where backslashes already stand there, so removing one
backslash restores the text exactly. Roles other than plain ASCII words are
written as ``=`` and the hexadecimal of their UTF-8 bytes.

Defined results: null text and null role count as empty; a null score is 0; a
parent that does not exist makes the node a root; nodes on or below a cycle
belong to no path and are left out; rows repeated in (tree, node) keep the first
by (role, text); equal ranks go to the smaller leaf id; a null tree id is a tree
like any other; an empty table gives an empty result. One conversation is one
output row, so a tree's chosen path must fit one row; ids alone travel until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import pin

START, MID, END = "<|im_start|>", "\n", "<|im_end|>\n"
_ANGLE, _SQUARE = r"(?=\||/?s>|</?SYS>>)", r"(?=/?INST\])"


def escape(text: Column) -> Column:
    one = F.regexp_replace(text, r"<(\\*)" + _ANGLE, r"<\\$1")
    return F.regexp_replace(one, r"\[(\\*)" + _SQUARE, r"[\\$1")


def unescape(text: Column) -> Column:
    one = F.regexp_replace(text, r"<\\(\\*)" + _ANGLE, r"<$1")
    return F.regexp_replace(one, r"\[\\(\\*)" + _SQUARE, r"[$1")


def _write_role(role: Column) -> Column:
    return F.when(role.rlike("^[A-Za-z_]*$"), role).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def _read_role(role: Column) -> Column:
    return F.when(role.startswith("="), F.decode(F.unhex(F.substring(role, 2, 2**31 - 1)), "UTF-8")).otherwise(role)


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Doubling tables. ``nodes(tree, node, parent, score)`` -> (jumps, sums):
    ``jumps[i]`` holds (tree, node, up): the 2**i-step ancestor, where there is
    one; ``sums`` holds (tree, node, depth, total) for nodes that reach a root."""
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_up"))
    step = (nodes.join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_up")), "left")
            .select("tree", "node", F.col("_up").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    step, jumps = pin(step, "tree"), []
    # no path is longer than the table: what still has an ancestor after that many doublings is on or below a cycle
    for _ in range(step.count().bit_length() + 1):
        jumps.append(step.where("up is not null").select("tree", "node", "up"))
        if jumps[-1].isEmpty():
            break
        far = step.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_s"))
        step = pin(step.join(far, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n")), "left")
                   .select("tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0).cast("long"))).alias("depth"),
                           (F.col("total") + F.coalesce("_s", F.lit(0.0))).alias("total")), "tree")
    return jumps, step.where("up is null").select("tree", "node", "depth", "total")


def choose_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """``nodes(tree, node, parent, score)`` -> (tree, path, node, pos): the nodes of
    the ``per_tree`` best root-to-leaf paths (all with None) by mean score,
    position 0 the root; ``path`` is the leaf's id."""
    jumps, sums = ancestors(nodes)
    inner = nodes.where("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = sums.join(inner, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    if per_tree is not None:
        best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
        leaves = leaves.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_tree)
    # a path enters at its own number of doublings and is halved from the top down, so all rounds together make about twice its nodes
    top = F.when(F.col("depth") > 1, F.length(F.bin(F.col("depth") - 1))).otherwise(0)
    leaves = pin(leaves.select("tree", F.col("node").alias("path"), "node", F.lit(0).alias("up_steps"), "depth", top.alias("top")), "leaves")
    path = leaves.where(F.col("top") > len(jumps)).drop("top")
    for i, jump in reversed(list(enumerate(jumps))):
        path = path.unionByName(leaves.where(F.col("top") == i + 1).drop("top"))
        far = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        pair = path.join(far, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left")
        both = F.array(F.struct("node", "up_steps"), F.struct(F.col("up").alias("node"), (F.col("up_steps") + 2**i).alias("up_steps")))
        path = pair.select("tree", "path", "depth", F.explode(F.filter(both, lambda x: x["node"].isNotNull())).alias("x")).select(
            "tree", "path", F.col("x.node").alias("node"), F.col("x.up_steps").alias("up_steps"), "depth")
    path = path.unionByName(leaves.where("top = 0").drop("top"))
    return path.select("tree", "path", "node", (F.col("depth") - 1 - F.col("up_steps")).alias("pos"))


def format_paths(paths: DataFrame, texts: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, path, formatted, turn_starts, loss_spans): one row per path.

    ``texts(tree, node, role, text)``. ``turn_starts`` are the code-point offsets
    of the turns in ``formatted``; ``loss_spans`` has one (start, end) per turn,
    null for turns that are not learned: a ``learn`` turn's escaped text.
    """
    t = texts.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(t, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    rows = rows.withColumn("_role", _write_role(F.col("role"))).withColumn("_text", escape(F.col("text")))
    head = F.concat(F.lit(START), F.col("_role"), F.lit(MID))
    rows = rows.select("tree", "path", "pos", F.concat(head, F.col("_text"), F.lit(END)).alias("piece"),
                       F.length(head).alias("head"), F.length("_text").alias("body"), (F.col("role") == learn).alias("learn"))
    run = Window.partitionBy("tree", "path").orderBy("pos")
    rows = rows.withColumn("start", F.sum(F.length("piece").cast("long")).over(run) - F.length("piece"))
    span = F.when(F.col("learn"), F.struct((F.col("start") + F.col("head")).alias("start"), (F.col("start") + F.col("head") + F.col("body")).alias("end")))
    turns = F.array_sort(F.collect_list(F.struct("pos", "piece", "start", span.alias("span"))))
    return rows.groupBy("tree", "path").agg(turns.alias("_turns")).select(
        "tree", "path", F.array_join(F.col("_turns.piece"), "").alias("formatted"),
        F.col("_turns.start").alias("turn_starts"), F.col("_turns.span").alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the learned text parsed out of ``formatted`` and its mask:
    adds turns array<struct<role, text>> and loss_text."""
    pieces = F.split("formatted", r"(?=<\|im_start\|>)")
    body = lambda p: F.substring(p, len(START) + 1, F.length(p) - len(START) - len(END))
    role = lambda b: F.substring_index(b, MID, 1)
    turn = lambda b: F.struct(_read_role(role(b)).alias("role"), unescape(
        F.substring(b, F.length(role(b)) + 2, F.length(b))).alias("text"))
    rows = formatted.withColumn("_pieces", F.filter(pieces, lambda p: p != ""))
    rows = rows.withColumn("turns", F.transform(F.transform("_pieces", body), turn))
    masked = F.zip_with(F.arrays_zip("_pieces", "turn_starts"), F.col("loss_spans"), lambda p, s: F.when(s.isNotNull(), unescape(
        F.substring(p["_pieces"], (s["start"] - p["turn_starts"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    return rows.withColumn("loss_text", F.array_join(F.filter(masked, lambda x: x.isNotNull()), "")).drop("_pieces")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by
    (turn, role, text); repeated rows are nodes of their own; score 0."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return (rows.select("conv_id", "turn", "role", "text").withColumn("node", n)
            .select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    F.lit(0.0).alias("score"), "role", "text"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Digest of all formatted conversations: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, read back from the output."""
    nodes = pin(conversation_nodes(rows), "nodes")
    done = read_back(format_paths(choose_paths(nodes.select("tree", "node", "parent", "score")), nodes))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
