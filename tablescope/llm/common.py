"""Helpers shared by the operators: written intermediates, word rules and bounded driver reads."""

from __future__ import annotations

import ctypes
import sys
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import scratch_path

#: A word is a run of anything but space and the five ASCII controls tab to carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the lineage is cut,
    later readers scan the files, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting: shuffle files go when the query that made them ends, not when the driver next collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Meanwhile shuffle files of a finished query are removed. Only for writes: a write plans
    its own shuffles, which nothing reads later."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


#: Rows of whole texts that are handed to Python at once.
TEXTS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to TEXTS_AT_ONCE: Spark's 10,000 rows of
    long texts would stand in the JVM's and in Python's memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= TEXTS_AT_ONCE:
        spark.conf.set(name, str(TEXTS_AT_ONCE))


def lean(run):
    """``run`` over batches; when a task is done its worker, which Spark keeps for the
    next one, gives the memory it no longer needs back to the system."""
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
    return wrapped


def words(text):
    """Array of the words of ``text`` (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def word_count(text):
    return F.size(words(text)).cast("long")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a summary whose size is bounded by configuration (sources,
    languages, rules); more than ``limit`` rows is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the documented bound")
    return rows


def held_out(doc_id):
    """The fold that no model learns from: crc32 of the id as text, remainder 2 of 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def seeded_sample(rows: DataFrame, group: str, size: int, seed: int, salts: int = 64) -> DataFrame:
    """At most ``size`` ids per group of slim ``rows(doc_id, group)``, those first in
    a seeded hash order. Ranked per (group, salt) first, so a group holding most
    rows is spread over ``salts`` tasks; the second ranking sees salts x size rows."""
    from pyspark.sql import Window
    h = rows.select("doc_id", group, F.xxhash64(F.lit(seed), "doc_id").alias("_h")).withColumn("_salt", F.pmod("_h", F.lit(salts)))
    first = Window.partitionBy(group, "_salt").orderBy("_h", "doc_id")
    every = Window.partitionBy(group).orderBy("_h", "doc_id")
    some = h.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= size)
    return some.withColumn("_r", F.row_number().over(every)).where(F.col("_r") <= size).select("doc_id", group).distinct()
