"""The reference's end-to-end sequence - inspect, clean, analyse - as plain
functions over DataFrames (no agents, prompts or prose; SURVEY 3.1).

Hand-over between the steps is by DataFrame lineage instead of files; files
are written only where the reference writes them (cleaned table, schema map,
transformation log), into a folder the caller names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from ..functions.columns import NUMERIC, TEXT, columns_of_class, require_columns
from ..operators import chartdata, clean, outliers, profile, stats, trend


@dataclass
class Findings:
    """Named result tables of one step."""
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def names(self) -> list[str]:
        return list(self.tables)


def inspect_table(df: DataFrame, approx: bool = False) -> Findings:
    """Ingestion inspection: overview, gaps, duplicates, schema map, completeness.
    The per-column counts behind the first three come from one aggregation,
    pinned once (one row per column)."""
    from ..session import materialize
    counts = materialize(profile.column_counts(df))
    return Findings({
        "overview": profile.overview_of(counts),
        "missing": profile.missing_of(counts),
        "duplicates": profile.duplicates(df),
        "schema_map": profile.schema_map(df, approx=approx),
        "completeness": profile.completeness_of(counts),
    })


def clean_table(df: DataFrame, out_dir: str | None = None, trim_first: bool = False) -> tuple[DataFrame, Findings]:
    """Cleaning step: the cleaned table and its step report. With ``out_dir`` the
    cleaned table is written once (CSV as the reference does, plus Parquet) and
    the returned table is read back from the Parquet copy, so later steps do
    not recompute the cleaning; the steps are appended to the log there."""
    cleaned, report = clean.quick_clean_with_report(df, trim_first=trim_first)
    if out_dir:
        base = out_dir.rstrip("/")
        sources.write_table(cleaned, f"{base}/cleaned_parquet", "parquet")
        cleaned = df.sparkSession.read.parquet(f"{base}/cleaned_parquet")
        sources.write_table(cleaned, f"{base}/cleaned_data", "csv")
        steps = report.selectExpr("step_no", "operation", "concat_ws(' ', column, fill_value) AS detail",
                                  "rows_before", "rows_after")
        sources.append_log(df.sparkSession, steps, f"{base}/transformation_log")
    return cleaned, Findings({"clean_report": report})


def analyse_table(df: DataFrame, value_col: str | None = None, group_col: str | None = None,
                  date_col: str | None = None, freq: str = "M") -> Findings:
    """Analysis step: statistics, outliers, trend and chart data for the chosen
    columns (the first numeric / text column when not given)."""
    numeric = columns_of_class(df, NUMERIC)
    text = columns_of_class(df, TEXT)
    value_col = value_col or (numeric[0] if numeric else None)
    group_col = group_col or (text[0] if text else None)
    out: dict[str, DataFrame] = {}
    if numeric:
        out["describe"] = profile.describe_numeric(df)
        if len(numeric) > 1:
            out["correlations"] = stats.correlation_matrix(df)
            out["strong_correlations"] = stats.strong_correlations(df)
    if text:
        out["describe_text"] = profile.describe_text(df)
    if value_col:
        require_columns(df, value_col)
        out["outliers"] = outliers.outlier_summary(df, value_col)
        out["histogram"] = chartdata.histogram(df, value_col)
        out["box"] = chartdata.box(df, value_col)
    if group_col:
        out["value_counts"] = stats.value_counts(df, group_col)
        out["bar"] = chartdata.bar(df, group_col)
        if value_col:
            from ..session import materialize
            summary = materialize(stats.group_summary(df, group_col, value_col))  # one pass, four statistics
            for func in stats.GROUP_FUNCS:
                out[f"group_{func}"] = stats.ranked(summary, group_col, func)
            out["box_by_group"] = chartdata.box(df, group_col, value_col)
    if date_col and value_col:
        out["trend_report"] = trend.trend_report(df, date_col, value_col, freq)
        out["line"] = chartdata.line(df, date_col, value_col)
    return Findings(out)


def run(spark: SparkSession, path: str, out_dir: str, value_col: str | None = None,
        group_col: str | None = None, date_col: str | None = None, freq: str = "M") -> dict[str, Findings]:
    """Load a delimited file, inspect, clean (writing the cleaned table, the schema map
    by column and as one document, and the log under ``out_dir``) and analyse the cleaned table as written (its
    lineage is cut there, as the reference's analysis reloads the cleaned file)."""
    raw = sources.read_delimited(spark, path)
    inspected = inspect_table(raw)
    sources.write_json(inspected["schema_map"], f"{out_dir.rstrip('/')}/schema_map")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    sources.write_json(profile.schema_document(raw, name), f"{out_dir.rstrip('/')}/schema_document")
    cleaned, cleaning = clean_table(raw, out_dir)
    analysed = analyse_table(cleaned, value_col, group_col, date_col, freq)
    return {"inspection": inspected, "cleaning": cleaning, "analysis": analysed}
