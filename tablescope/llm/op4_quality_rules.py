"""Quality rules whose cutoffs are certified on labelled holdouts (risk-controlled thresholds).

Every rule is a share that grows as text gets worse. For each stratum (language)
and rule a fixed grid of cutoffs is tested on the labelled good documents that
pass the base rule: with ``k`` of ``n`` good documents above a cutoff, the null
hypothesis "the rule rejects more than ``risk / rules`` of good documents" is
rejected when the exact binomial P(X <= k | n, risk / rules) is at most
``delta / tests``, ``tests`` being strata x rules x cutoffs (Bonferroni). By the
union bound, with confidence 1 - delta all chosen rules together falsely reject
at most ``risk`` of the good documents of every stratum at once. Since all
certified cutoffs hold simultaneously, the one used may be picked freely: the
one with the best (bad share rejected) - ``caution`` x (good share rejected),
the laxer one on ties, none where that is not positive or nothing is certified.

Native expressions only. Texts are measured in one pass; the slim measures are
written once. Labels join by shuffle; all else is grouped on stratum, rule and
grid cell with map-side partial sums, so a hot language costs one row per task.

Defined results: a null or empty text has no words and fails the base rule; a
null language is a stratum of its own; unlabelled strata certify nothing and
reject nothing beyond the base rule; repeated label rows count once (the lowest
quality wins); repeated documents keep a row each; an empty table gives an
empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import WORD_GAP, pin, words

RISK, DELTA, CAUTION = 0.05, 0.05, 5.0

#: rule -> (numerator, denominator); a document is rejected when the share is above the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouting": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs tested for every rule, from strict to lax.
GRID = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a one-element transform binds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(grams: Column) -> Column:
    """Words covered by the 3-word windows whose hash is found twice or more."""
    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: (x["h"] == F.try_element_at(pairs, i + 2)["h"])
                         | ((i > 0) & (x["h"] == F.try_element_at(pairs, F.when(i > 0, i))["h"])))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    ranked = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(ranked, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures and base_failed; whole texts, no shuffle."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    drop = lambda chars: F.regexp_replace(t, chars, "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    wide = docs.withColumn("_w", words(t)).withColumn("_lines", lines)
    gram = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(
        F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    wide = wide.withColumn("_g", gram)
    count = lambda c: c.cast("long")
    out = (wide.withColumn("n_words", count(F.size("_w")))
           .withColumn("word_chars", count(F.length(drop(WORD_GAP))))
           .withColumn("n_symbols", count(F.length(drop("[^#*$%&|<>]+"))))
           .withColumn("n_dup_lines", count(F.size("_lines") - F.size(F.array_distinct("_lines"))))
           .withColumn("n_repeat_words", _repeat_words(F.col("_g")))
           .withColumn("n_lines", count(F.size("_lines")))
           .withColumn("n_upper", count(F.length(drop("[^\\p{Lu}]+"))))
           .withColumn("n_marks", count(F.length(drop("[^!?]+")))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "_lines", "_g")


def _cells() -> Column:
    """Per rule, the number of cutoffs that the document's share exceeds."""
    def cell(name: str) -> Column:
        num, den = (F.col(c).cast("double") for c in RULES[name])
        share = F.when(den > 0, num / den).otherwise(F.lit(0.0))
        n = F.lit(0)
        for c in GRID:
            n = n + F.when(share > c, 1).otherwise(0)
        return n.alias(name)
    return F.array(*[cell(r) for r in RULES])


def most_rejected(n: Column, share: float, level: Column) -> Column:
    """The largest k with P(X <= k | n, share) <= level, -1 if none: the exact
    binomial distribution summed term by term (terms kept as logarithms)."""
    odds = F.lit(math.log(share / (1 - share)))
    start = F.struct((n * F.lit(math.log(1 - share))).alias("term"),
                     F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = F.when(i == 0, a["term"]).otherwise(a["term"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))) + odds)
        cdf = a["cdf"] + F.exp(term)
        return F.struct(term.alias("term"), cdf.alias("cdf"), F.when(cdf <= level, i).otherwise(a["k"]).alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * share)), start, step, lambda a: a["k"])


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, caution: float = CAUTION) -> DataFrame:
    """One row per (stratum, rule): tests, certified cutoff index and counts. Bounded by languages x rules."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = (measured.where("not base_failed").join(marks, "doc_id")
            .select("stratum", "cells", (F.col("quality") >= 1).cast("long").alias("good")))
    cells = (held.select("stratum", "good", F.posexplode("cells").alias("rule", "cell"))
             .groupBy("stratum", "rule", "cell").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    span = Window.partitionBy("stratum", "rule")
    # cutoff j rejects the cells above j; the grid is laid out in full for every stratum and rule
    total = cells.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
                                                 F.map_from_entries(F.collect_list(F.struct("cell", F.struct("good", "bad")))).alias("at"))
    above = lambda f: F.aggregate(F.sequence(F.col("cut") + 1, F.lit(len(GRID))), F.lit(0).cast("long"),
                                  lambda a, c: a + F.coalesce(F.try_element_at("at", c)[f], F.lit(0).cast("long")))
    tests = (total.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy()) * len(GRID))
             .withColumn("allowed", most_rejected(F.col("n_good"), risk / len(RULES), F.lit(delta) / F.col("tests")))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("cut"))
             .withColumn("k", above("good")).withColumn("hits", above("bad")).drop("at"))
    gain = F.col("hits") / F.greatest("n_bad", F.lit(1)) - caution * F.col("k") / F.greatest("n_good", F.lit(1))
    best = tests.where("k <= allowed").withColumn("gain", gain).where("gain > 0")
    return (best.withColumn("_r", F.row_number().over(span.orderBy(F.desc("gain"), F.desc("cut")))).where("_r = 1").drop("_r"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rules_hit."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    slim = docs.select("doc_id", lang.alias("lang"), "text")
    measured = measure(slim).withColumn("cells", _cells()).withColumn("stratum", F.coalesce("lang", F.lit("\x00"))).drop("text", "lang")
    measured = pin(measured, "measures")
    cuts = (certify(measured, labels, risk, delta)
            .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts")))
    hit = F.filter(F.transform(F.col("cells"), lambda c, r: F.when(c > F.try_element_at("cuts", r), F.element_at(
        F.array(*[F.lit(x) for x in RULES]), r + 1))), lambda x: x.isNotNull())
    out = measured.join(cuts, "stratum", "left").withColumn("rules_hit", F.coalesce(hit, F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.size("rules_hit") == 0)).alias("kept"), "rules_hit")
