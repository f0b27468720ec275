"""Line dedup: lines that many documents share stay in one document only.

Every line is reduced to its key (blanks stripped, A-Z lower-cased) and the key to
a 128-bit hash. Distinct documents are counted per hash, and a hash over the
threshold drops its lines everywhere but in the document of the largest id. Only
(hash, document, position) rows are counted and joined; texts move once, to meet
the positions that they lose. Built-in functions throughout.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import pin

MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Space and the ASCII controls tab to carriage return.
BLANKS = " \t\n\x0b\f\r"


def line_keys(text):
    """The keys of a text's lines, in order."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lowered, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))


def _row_key(text) -> list:
    """Two hashes that know a row: rows of equal id and text lose the same lines."""
    return [F.xxhash64(F.lit(k), F.col("doc_id"), text) for k in (1, 2)]


def _without(text: str, lost: str):
    """``text`` without its lines at the places ``lost``: the runs of lines between
    neighbouring lost places, so the work is in proportion to the lines."""
    lines = F.split(text, "\n")
    bounds = F.concat(F.array(F.lit(-1)), F.sort_array(lost), F.array(F.size(lines)))
    once = F.array(F.struct(lines.alias("lines"), bounds.alias("bounds")))
    return F.transform(once, lambda t: F.array_join(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(t["bounds"]) - 2),
        lambda i: F.slice(t["lines"], t["bounds"][i] + 2, t["bounds"][i + 1] - t["bounds"][i] - 1))), "\n"))[0]


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the same columns, ``text`` without the lines whose
    key has ``min_chars`` code points or more and stands in ``min_documents``
    documents or more, unless the document has the largest id of those; with
    ``n_lines`` (before) and ``n_dropped`` as new last columns (columns of those
    names in ``docs`` are replaced).

    A null text is the empty text, one empty line. A document is a doc_id: rows of
    one id count once, and each is judged by that id. The null id counts as one
    document, smaller than all others. A text that loses every line becomes empty.
    Equal rows all stay. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = _row_key(text)
    lines = (docs.select("doc_id", h1.alias("t1"), h2.alias("t2"), F.posexplode(line_keys(text)).alias("pos", "key"))
             .where(F.char_length("key") >= min_chars)
             .select("doc_id", "t1", "t2", "pos", F.xxhash64(F.lit(1), "key").alias("k1"), F.xxhash64(F.lit(2), "key").alias("k2")))
    lines = pin(lines, "lines")
    # Distinct ids first (rows of a hot line spread by id), then partial counts per hash.
    common = (lines.select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2")
              .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_documents))
    common = pin(common.select("k1", "k2", "last"), "common-lines")  # read from files, so that the join below can split a hot line
    lost = (lines.join(common, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
            .groupBy("t1", "t2").agg(F.collect_set("pos").alias("lost")))
    named = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in named]).alias("row"), text.alias("_text"), h1.alias("t1"), h2.alias("t2"))
    met = whole.join(lost, ["t1", "t2"], "left")
    out = met.select("row", F.when(F.col("lost").isNull(), F.col("_text")).otherwise(_without("_text", "lost")).alias("kept"),
                     (F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                     F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in named], "n_lines", "n_dropped")


def line_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    kept = drop_common_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
