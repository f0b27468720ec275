"""Column checks and type classes (numeric / text / datetime / boolean)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
TEXT = "text"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"


def type_class(dt: T.DataType) -> str:
    """Logical class of a Spark type. Boolean is not numeric (SURVEY D-types)."""
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, T.NumericType):
        return NUMERIC
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def col_of(name: str) -> Column:
    """The column of exactly this name, also where it holds dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, *cols: str) -> None:
    """Raise ValueError naming the available columns when one is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found; available: {df.columns}")


def field(df: DataFrame, name: str) -> T.StructField:
    require_columns(df, name)
    return df.schema[name]


def columns_of_class(df: DataFrame, klass: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) == klass]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, NUMERIC)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, TEXT)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of_class(df, DATETIME)


def require_numeric(df: DataFrame, name: str) -> None:
    if type_class(field(df, name).dataType) != NUMERIC:
        raise ValueError(f"column '{name}' is not numeric; numeric columns: {numeric_columns(df)}")


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_exact_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType))


def missing_as_null(df: DataFrame, name: str) -> Column:
    """The column with NaN mapped to NULL for float types (pandas treats NaN as missing)."""
    c = col_of(name)
    if is_floating(df.schema[name].dataType):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the float columns (all float columns when ``cols`` is None)."""
    targets = [f.name for f in df.schema.fields
               if is_floating(f.dataType) and (cols is None or f.name in cols)]
    if not targets:
        return df
    return df.withColumns({c: missing_as_null(df, c) for c in targets})
