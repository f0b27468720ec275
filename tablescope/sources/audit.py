"""Transformation log: append-only JSON lines with a timestamp.

The reference appends Markdown lines to a local file from one process; here
entries are rows appended to a folder on shared storage, so any job (or
several at once) can add to the log and Spark can read it back as a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "step_no int, operation string, detail string, rows_before long, rows_after long"


def log_frame(spark: SparkSession, entries: Sequence[str] | DataFrame) -> DataFrame:
    """Messages (one per step) or a step table as log rows ``(step_no, operation, detail,
    rows_before, rows_after)``."""
    if isinstance(entries, DataFrame):
        return entries
    rows = [(i + 1, "note", str(m), None, None) for i, m in enumerate(entries)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def append_log(spark: SparkSession, entries: Sequence[str] | DataFrame, path: str) -> DataFrame:
    """Append entries with ``logged_at`` (UTC time of the write) to the log folder;
    returns the rows as written."""
    now = datetime.now(timezone.utc)
    now = now.replace(microsecond=now.microsecond // 1000 * 1000)  # JSON text keeps milliseconds
    frame = log_frame(spark, entries).withColumn("logged_at", F.lit(now))
    frame.write.mode("append").json(path)
    return frame


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log as a table."""
    return spark.read.schema(LOG_SCHEMA + ", logged_at timestamp").json(path)
