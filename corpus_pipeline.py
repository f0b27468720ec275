"""The corpus pipeline: documents through five operators, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. The first four return the columns of documents; the last returns token ids.
Rows are judged one by one: the first three stages know a row by a 64-bit hash of
all its columns, not by its doc_id, which may be null or repeated. Identical rows
share a decision; near-dedup keeps one of them. (Of ten billion rows about three pairs
share a hash by chance: in stages 1 and 2 both go if one is rejected; near-dedup tells
them apart by a second hash.) Decisions meet the documents by a shuffled join.

Every stage takes null ids, texts, languages and sources, empty and very long texts,
ties, repeated rows, an empty table (the result is empty) and extra columns of any
name, which stay as they are up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import op3_minhash_dedup, op4_quality_rules, op6_quality_lm, op9_source_mix, op10_bpe_automaton
from tablescope.llm.common import load, pin

TOKENIZER = "byte_bpe_50k.json"


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key, check): each row as it is, and two hashes of it. A null column counts, which xxhash64 alone passes over."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = [x for c in columns for x in (c.isNull(), c)]
    return docs.select(F.struct(*columns).alias("row"), F.xxhash64(*parts).alias("key"), F.xxhash64(F.lit("check"), *parts).alias("check"))


def _by_key(keyed: DataFrame) -> DataFrame:
    """The documents as the operators read them, the row's key in place of the id."""
    return keyed.select(F.col("key").alias("doc_id"), "row.lang", "row.text")


def _keep(docs: DataFrame, labels: DataFrame, judge) -> DataFrame:
    """Rows that ``judge(docs, labels)`` keeps. A label holds for every row of its doc_id."""
    keyed = _keyed(docs)
    ids = keyed.where("row.doc_id is not null").select("row.doc_id", "key").distinct()
    marks = labels.select("doc_id", "quality").distinct().join(ids, "doc_id").select(F.col("key").alias("doc_id"), "quality")
    kept = judge(_by_key(keyed), pin(marks, "row-labels")).groupBy(F.col("doc_id").alias("key")).agg(F.min("kept").alias("kept")).where("kept").select("key")
    return keyed.join(kept, "key", "left_semi").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of high perplexity under the model of trusted text, and those
    without a word (null and empty texts), which have none. Without any trusted text
    every document with a word stays. Rows that tie with the threshold stay."""
    return _keep(docs, load(spark, sf_dir, "labels"), op6_quality_lm.judge)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule (null and empty texts do) or a certified
    cutoff. With too few labels to certify one, the base rule alone decides."""
    return _keep(docs, load(spark, sf_dir, "labels"), op4_quality_rules.judge)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest id (a null id is the
    largest; rows that tie go by their hash). Texts without words are near to nothing and stay."""
    keyed = _keyed(docs)
    groups = op3_minhash_dedup.near_documents(_by_key(keyed)).select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = (groups.join(keyed.select("key", "row.doc_id").distinct(), "key").groupBy("component_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select("first.key"))
    return keyed.join(first, "key", "left_semi").dropDuplicates(["key", "check"]).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none more than twice. A null source
    is a source; texts without words have no size and are not taken. Ties go by a seeded hash."""
    return op9_source_mix.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids of every document of the mix; a null text
    is empty and has no tokens. Repeated rows and ids keep a row each; other columns end here."""
    ids = op10_bpe_automaton.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding", tokens),
]

#: SQL cannot express the language model, the certified cutoffs' inputs or the tokenizer; tests/llm/test_pipeline_rows.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pin(docs, f"pipeline-{k}")
    return docs
