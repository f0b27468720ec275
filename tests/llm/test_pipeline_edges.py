"""Stages of the pipeline on empty tables and on extra columns whose names the stages might use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

EXTRA = ["_key", "key", "row", "check", "kept", "_row", "takes", "h", "n", "a.b", "component_id"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    words = "stone river light winter garden letter table music paper forest".split()
    rows = [(i, " ".join(words[(i * 7 + k * (i % 5 + 1) + k // 9) % 10] + words[(i + k * k) % 10] for k in range(70)), "en", f"s{i % 2}") for i in range(20)]
    rows += [rows[3], (None, rows[4][1], None, None), (21, None, "en", "s0"), (22, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in EXTRA])
    docs.write.parquet(f"{top}/documents.parquet")
    return top


@pytest.mark.parametrize("k", range(4))
def test_extra_columns_stay(spark, folder, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}-{-1 if r.doc_id is None else r.doc_id}" for r in got for c in EXTRA)


def test_an_empty_table_passes_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.pin(stage(spark, docs, folder), "edge")
        assert docs.count() == 0
