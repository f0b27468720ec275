"""Shared column checks, safe expressions, distributed quantiles and modes."""

from .columns import (BOOLEAN, DATETIME, NUMERIC, OTHER, TEXT, columns_of_class, datetime_columns,
                      missing_as_null, nan_to_null, numeric_columns, require_columns, require_numeric,
                      text_columns, type_class)
from .exprs import corr_of, mean_of, pct, safe_div, std_of, strip_ws, sum_of
from .modes import modes, value_summary
from .quantiles import quantile_values, quantiles

__all__ = [
    "BOOLEAN", "DATETIME", "NUMERIC", "OTHER", "TEXT", "columns_of_class", "datetime_columns",
    "missing_as_null", "nan_to_null", "numeric_columns", "require_columns", "require_numeric",
    "text_columns", "type_class", "corr_of", "mean_of", "pct", "safe_div", "std_of", "strip_ws",
    "sum_of", "modes", "value_summary", "quantile_values", "quantiles",
]
