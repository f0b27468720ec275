"""Sinks: cleaned-table writer, row count of a written output, JSON profile
(SURVEY S6, S7, S10). Paths are folders written by the executors in parallel;
on a cluster they must be on shared storage (see ``session.scratch_path``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", sep: str = ",",
                null_value: str = "") -> str:
    """Write ``df`` (CSV with a header by default; ``.csv`` is appended to a CSV
    path that lacks it, as the reference does). Text is written verbatim
    (no whitespace trimming); array, map and struct values as JSON text.
    Returns the path written."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format '{fmt}'; use one of {list(FORMATS)}")
    if fmt == "csv":  # CSV holds text only: nested values are written as JSON, timestamps with any fraction of a second
        stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in stamps}) if stamps else df
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        if nested:
            df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})
    w = df.write.mode(mode)
    if fmt == "csv":
        if not path.endswith(".csv"):
            path += ".csv"
        (w.option("header", True).option("sep", sep).option("nullValue", null_value)
         .option("emptyValue", '""').option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.json(path)
    return path


def count_written(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One row ``(path, rows)`` counted from what was written (a lazy, distributed count)."""
    if fmt == "csv":
        written = (spark.read.option("header", True).option("multiLine", True)
                   .option("quote", '"').option("escape", '"').csv(path))  # as written
    elif fmt == "parquet":
        written = spark.read.parquet(path)
    else:
        written = spark.read.json(path)
    return written.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(path).alias("path"), "rows")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a profile (or any small report frame) as JSON lines."""
    df.write.mode(mode).json(path)
    return path
