"""Profiling of delimited files as they arrive in a folder.

The reference loads one file per run and has no streaming. The one piece that
carries over to files arriving continuously is the load inspection: per-column
present/missing counts. ``overview_stream`` keeps them as a stateful
Structured Streaming aggregation (running totals over all files seen, state
in the checkpoint folder), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.delimited import NULL_TOKENS


def read_folder_stream(spark: SparkSession, folder: str, schema: T.StructType, sep: str = ",",
                       encoding: str = "UTF-8") -> DataFrame:
    """Streaming read of the CSV files landing in ``folder`` (a schema is required
    for streams); missing-value tokens become NULL."""
    raw = (spark.readStream.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
           .option("header", True).option("sep", sep).option("encoding", encoding)
           .option("quote", '"').option("escape", '"').csv(folder))
    toks = list(NULL_TOKENS)
    cols = []
    for f in schema.fields:
        v = F.when(F.col(f.name).isin(toks), F.lit(None).cast("string")).otherwise(F.col(f.name))
        if not isinstance(f.dataType, T.StringType):
            v = v.try_cast(f.dataType)
        cols.append(v.alias(f.name))
    return raw.select(*cols)


def overview_stream(stream: DataFrame) -> DataFrame:
    """Running ``(position, column, non_null, nulls)`` over every row seen so far
    (a global streaming aggregation; use output mode ``complete``)."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(c)).alias(f"_nn{i}")
                                                 for i, c in enumerate(stream.columns)]
    row = stream.agg(*aggs)
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"_nn{i}").alias("non_null"),
                      (F.col("_rows") - F.col(f"_nn{i}")).alias("nulls"))
             for i, c in enumerate(stream.columns)]
    return row.select(F.inline(F.array(*items)))


def start_overview(spark: SparkSession, folder: str, schema: T.StructType, query_name: str,
                   checkpoint: str, sep: str = ","):
    """Start the running overview into an in-memory table named ``query_name``
    (for notebooks and tests); returns the StreamingQuery."""
    stream = read_folder_stream(spark, folder, schema, sep)
    return (overview_stream(stream).writeStream.outputMode("complete").format("memory")
            .queryName(query_name).option("checkpointLocation", checkpoint).start())
