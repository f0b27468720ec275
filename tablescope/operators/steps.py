"""Declared transformation steps, missing-row filter and the year/category
filter (SURVEY X1, F4, F7).

The reference evaluates free pandas expressions chosen at run time. Here a
step is a small declared verb whose arguments are Spark SQL expressions, so
every step stays a Catalyst plan node (filters push down, projections prune)
and nothing is evaluated in Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of, DATETIME, missing_as_null, require_columns, type_class

VERBS = ("filter", "select", "drop", "rename", "derive", "cast", "dropna", "fillna", "replace", "dedupe",
         "sort", "limit", "aggregate")
# steps that never change the number of rows
ROW_PRESERVING = ("drop", "rename", "derive", "cast", "fillna", "replace", "sort")


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """rows where every column of ``subset`` (all columns by default) is present;
    NaN counts as missing."""
    cols = list(subset) if subset is not None else df.columns
    require_columns(df, *cols)
    cond = F.lit(True)
    for c in cols:
        cond = cond & missing_as_null(df, c).isNotNull()
    return df.where(cond)


def filter_year_category(df: DataFrame, date_col: str, year="all", col: str | None = None,
                         value="all") -> DataFrame:
    """keep one year of ``date_col`` and/or one value of ``col``; ``"all"`` keeps all.
    A stored date or timestamp column gives a range predicate, which is pushed to
    the scan; any other type is read as a date first (unreadable text matches no year)."""
    require_columns(df, date_col, *([col] if col else []))
    out = df
    if str(year) != "all":
        first, after = (F.make_date(F.lit(int(year) + i), F.lit(1), F.lit(1)) for i in (0, 1))
        stored = type_class(df.schema[date_col].dataType) == DATETIME
        when = col_of(date_col) if stored else col_of(date_col).cast("string").try_cast("timestamp")
        out = out.where((when >= first) & (when < after))
    if col and str(value) != "all":
        out = out.where(col_of(col) == F.lit(value))
    return out


def _step(df: DataFrame, step: Mapping) -> tuple[DataFrame, str]:
    op = step.get("op")
    if op == "filter":
        return df.where(F.expr(step["cond"])), step["cond"]
    if op == "select":
        return df.select(*[F.expr(e) for e in step["cols"]]), ", ".join(step["cols"])
    if op == "drop":
        require_columns(df, *step["cols"])
        return df.drop(*step["cols"]), ", ".join(step["cols"])
    if op == "rename":
        require_columns(df, *step["mapping"].keys())
        return df.withColumnsRenamed(dict(step["mapping"])), repr(dict(step["mapping"]))
    if op == "derive":
        return df.withColumn(step["name"], F.expr(step["expr"])), f"{step['name']} = {step['expr']}"
    if op == "cast":
        require_columns(df, step["col"])
        return (df.withColumn(step["col"], col_of(step["col"]).try_cast(step["type"])),
                f"{step['col']} AS {step['type']}")
    if op == "dropna":
        return drop_missing(df, step.get("subset")), ", ".join(step.get("subset") or df.columns)
    if op == "fillna":
        return df.na.fill(dict(step["values"])), repr(dict(step["values"]))
    if op == "replace":
        require_columns(df, step["col"])
        return df.na.replace(dict(step["mapping"]), subset=[step["col"]]), f"{step['col']}: {dict(step['mapping'])!r}"
    if op == "dedupe":
        sub = step.get("subset")
        return (df.dropDuplicates(list(sub)) if sub else df.dropDuplicates()), ", ".join(sub or [])
    if op == "sort":
        asc = step.get("ascending", True)
        cols = [col_of(c).asc() if asc else col_of(c).desc() for c in step["cols"]]
        return df.orderBy(*cols), ", ".join(step["cols"])
    if op == "limit":
        return df.limit(int(step["n"])), str(step["n"])
    if op == "aggregate":
        exprs = [F.expr(e).alias(name) for name, e in step["exprs"].items()]
        keys = list(step.get("keys") or [])
        return df.groupBy(*keys).agg(*exprs), f"by {keys}: {dict(step['exprs'])!r}"
    raise ValueError(f"unknown step '{op}'; use one of {list(VERBS)}")


def _alive(df: DataFrame, step: Mapping, flag: str) -> DataFrame | None:
    """``step`` on rows that carry ``flag``: rows that it drops stay, unflagged, and are
    spared from its expressions. None for steps that need the rows themselves."""
    op, held = step["op"], F.col(flag)
    if op == "filter":
        return df.withColumn(flag, held & F.coalesce(F.when(held, F.expr(step["cond"])), F.lit(False)))
    if op == "dropna":
        subset = step.get("subset") or [c for c in df.columns if not c.startswith(FLAG)]
        require_columns(df, *subset)
        present = F.lit(True)
        for c in subset:
            present = present & missing_as_null(df, c).isNotNull()
        return df.withColumn(flag, held & present)
    if op == "derive":
        return df.withColumn(step["name"], F.when(held, F.expr(step["expr"])))
    if op == "select":
        flags = [c for c in df.columns if c.startswith(FLAG)]
        names = df.drop(*flags).select(*[F.expr(e) for e in step["cols"]]).columns
        if len(names) != len(step["cols"]):  # a star
            return None
        return df.select(*[F.when(held, F.expr(e)).alias(n) for e, n in zip(step["cols"], names, strict=True)], *flags)
    return _step(df, step)[0] if op in ROW_PRESERVING else None


def _row_counts(df: DataFrame, steps: Sequence[Mapping], stages: Sequence[DataFrame]) -> list[int]:
    """Rows before the first step and after each. Steps that work row by row are counted
    together in one pass over their input; dedupe, limit and aggregate start a new one."""
    counts: list[int] = []
    marked, flags = df.withColumn(f"{FLAG}0", F.lit(True)), [f"{FLAG}0"]
    for k, step in enumerate([*steps, None]):
        following = _alive(marked.withColumn(f"{FLAG}{k + 1}", F.col(flags[-1])), step, f"{FLAG}{k + 1}") if step else None
        if following is not None:
            marked, flags = following, [*flags, f"{FLAG}{k + 1}"]
            continue
        row = marked.agg(*[F.count_if(f).alias(f) for f in flags]).first()
        counts += [row[f] for f in flags]
        if step:
            marked, flags = stages[k].withColumn(f"{FLAG}{k + 1}", F.lit(True)), [f"{FLAG}{k + 1}"]
    return counts


#: Names of the columns that mark which rows a step has kept while steps are counted.
FLAG = "__kept_after_step_"


def apply_steps(df: DataFrame, steps: Sequence[Mapping], with_counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply the steps in order; returns ``(result, audit)`` where the audit has
    one row per step ``(step_no, operation, detail, rows_before, rows_after,
    columns_before, columns_after)``.

    Counting takes one pass for all steps up to a dedupe, limit or aggregate, and one
    more for what follows each of those. ``with_counts=False`` leaves the row counts
    NULL and runs no job.
    """
    stages, details = [df], []
    for step in steps:
        out, detail = _step(stages[-1], step)
        stages.append(out)
        details.append(detail)
    counts = _row_counts(df, steps, stages[1:]) if with_counts and steps else [None] * len(stages)
    audit = [(i + 1, step["op"], details[i], counts[i], counts[i + 1], len(stages[i].columns), len(stages[i + 1].columns)) for i, step in enumerate(steps)]
    frame = df.sparkSession.createDataFrame(
        audit, "step_no int, operation string, detail string, rows_before long, rows_after long, columns_before int, columns_after int")
    return stages[-1], frame
