"""

Every registered query reads the whole given tables (or a view Spark derives
from them) and runs the library operator it is named after. Where the test
tables hold no missing values, duplicates or padding, the query first derives
such a view with the deterministic expressions listed in FIXTURES.md; the same
expressions appear in the oracle SQL. Value columns that are summed are read as
DECIMAL(18,2) (they hold cents), so sums are exact on both engines.

Oracle rounding: Spark's ``round(double, d)`` rounds the shortest decimal
representation half-up; DuckDB's rounds the binary value. The oracles
reproduce Spark's rule with ``R(expr, d)`` (see ``_r``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope import sources
from tablescope.operators import chartdata, clean, outliers, profile, stats, steps, trend
from tablescope.session import scratch_path

SF_SMOKE = "/root/testdata/sf0.001"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(key: str, sql: str | None):
    def wrap(fn):
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = sql.strip()
        return fn
    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _r(expr: str, digits: int) -> str:
    """DuckDB spelling of Spark's round(double, digits)."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


def _cents(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)").alias(c)


def _qsql(src, x, probs, by=None):
    """Linear-interpolated quantiles spelled out: order statistics by row_number,
    then lo + (pos - floor(pos)) * (hi - lo) with pos = (n-1)*p in double
    (the library's definition; DuckDB's quantile_cont differs in the last bit)."""
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    inner = (f"SELECT {key}CAST({x} AS DOUBLE) AS _x, row_number() OVER ({part}ORDER BY {x}) - 1 AS _rk, "
             f"count(*) OVER ({part.strip()}) AS _n FROM {src} WHERE {x} IS NOT NULL")
    cols = []
    for i, pr in enumerate(probs):
        pos = f"(CAST(_n - 1 AS DOUBLE) * CAST({pr!r} AS DOUBLE))"
        lo = f"max(CASE WHEN _rk = floor({pos}) THEN _x END)"
        hi = f"max(CASE WHEN _rk = ceil({pos}) THEN _x END)"
        cols.append(f"{lo} + (any_value({pos}) - floor(any_value({pos}))) * ({hi} - {lo}) AS q{i}")
    grp = f" GROUP BY {by}" if by else ""
    return f"(SELECT {key}{', '.join(cols)} FROM ({inner}){grp})"


# ---------------------------------------------------------------- A1, A2: grouped stats
def _lineitem_price(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", _cents("l_extendedprice"))


@register("group_sum", """
SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def q_group_sum(spark, d):
    out = stats.group_stats(_lineitem_price(spark, d), "l_returnflag", "l_extendedprice", "sum")
    return out.select("l_returnflag", F.col("sum").cast("double").alias("sum_price"))


@register("group_mean", f"""
SELECT l_returnflag, {_r("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice)", 6)} AS mean_price
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def q_group_mean(spark, d):
    out = stats.group_stats(_lineitem_price(spark, d), "l_returnflag", "l_extendedprice", "mean")
    return out.select("l_returnflag", F.round("mean", 6).alias("mean_price"))


@register("group_count", """
SELECT o_orderpriority, count(o_totalprice) AS n
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_group_count(spark, d):
    o = load(spark, d, "orders")
    out = stats.group_stats(o, "o_orderpriority", "o_totalprice", "count")
    return out.select("o_orderpriority", F.col("count").alias("n"))


_STD_SQL = ("sqrt(CAST(count({x}) * sum(CAST({x} AS DECIMAL(18,2)) * CAST({x} AS DECIMAL(18,2))) "
            "- sum(CAST({x} AS DECIMAL(18,2))) * sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) "
            "/ CAST(count({x}) * (count({x}) - 1) AS DOUBLE))")


@register("group_std", f"""
SELECT o_orderpriority, {_r(_STD_SQL.format(x="o_totalprice"), 6)} AS std_price
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_group_std(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", _cents("o_totalprice"))
    out = stats.group_stats(o, "o_orderpriority", "o_totalprice", "std")
    return out.select("o_orderpriority", F.round("std", 6).alias("std_price"))


@register("value_counts", f"""
WITH c AS (SELECT o_orderpriority, count(*) AS cnt FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
     t AS (SELECT sum(cnt) AS total FROM c)
SELECT o_orderpriority, cnt AS count, {_r("100.0 * cnt / total", 2)} AS pct
FROM c, t ORDER BY cnt DESC, o_orderpriority LIMIT 20""")
def q_value_counts(spark, d):
    return stats.value_counts(load(spark, d, "orders"), "o_orderpriority", 20)


# ---------------------------------------------------------------- derived views (FIXTURES.md)
_GAPPED_COLS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "CASE WHEN o_orderkey % 5 = 0 THEN concat('  ', o_orderstatus, ' ') ELSE o_orderstatus END",
    "o_totalprice": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
    "o_orderdate": "o_orderdate",
    "o_orderpriority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
}
GAPPED = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPPED_COLS.items()) + " FROM orders)"


def gapped_orders(spark, d):
    """orders with numeric gaps, text gaps and padded text (no rows dropped)."""
    return load(spark, d, "orders").select(*[F.expr(e).alias(c) for c, e in _GAPPED_COLS.items()])


def _union_sql(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- P1-P7: profiling
_GAPPED_TYPES = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
                 ("o_orderstatus", "string", "text"), ("o_totalprice", "double", "numeric"),
                 ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "text")]


@register("profile_overview", _union_sql([
    f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, '{k}' AS type_class, "
    f"count({c}) AS non_null, count(*) - count({c}) AS nulls FROM {GAPPED}"
    for i, (c, t, k) in enumerate(_GAPPED_TYPES)]))
def q_profile_overview(spark, d):
    return profile.overview(gapped_orders(spark, d))


@register("profile_missing", "SELECT * FROM (" + _union_sql([
    f"SELECT {i} AS position, '{c}' AS column, count(*) - count({c}) AS missing, "
    f"{_r(f'100.0 * (count(*) - count({c})) / count(*)', 2)} AS missing_pct FROM {GAPPED}"
    for i, (c, t, k) in enumerate(_GAPPED_TYPES)]) + ") WHERE missing > 0")
def q_profile_missing(spark, d):
    return profile.missing(gapped_orders(spark, d))


@register("profile_duplicates", f"""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       {_r("100.0 * sum(n - 1) / sum(n)", 1)} AS duplicate_pct FROM g""")
def q_profile_duplicates(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return profile.duplicates(li)


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
           "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_CENTS = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def _lineitem_cents(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(*[_cents(c) if c in _LI_CENTS else F.col(c) for c in li.columns])


def _exact_sql(c):
    return f"CAST({c} AS DECIMAL(18,2))" if c in _LI_CENTS else f"CAST({c} AS DECIMAL(38,0))"


def _mean_sql(x):
    return f"CAST(sum({x}) AS DOUBLE) / count({x})"


def _std_sql(x):
    return (f"CASE WHEN count({x}) < 2 THEN NULL ELSE sqrt(CAST(count({x}) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE)"
            f" / CAST(count({x}) * (count({x}) - 1) AS DOUBLE)) END")


@register("describe_numeric", _union_sql([
    f"SELECT '{c}' AS column, m.count, m.mean, m.std, m.min, q.q0 AS p25, q.q1 AS p50, q.q2 AS p75, m.max FROM "
    f"(SELECT count(x) AS count, {_mean_sql('x')} AS mean, {_std_sql('x')} AS std, "
    f"CAST(min(x) AS DOUBLE) AS min, CAST(max(x) AS DOUBLE) AS max FROM (SELECT {_exact_sql(c)} AS x FROM lineitem)) m, "
    f"{_qsql(f'(SELECT {_exact_sql(c)} AS x FROM lineitem)', 'x', [0.25, 0.5, 0.75])} q"
    for c in _LI_NUM]))
def q_describe_numeric(spark, d):
    return profile.describe_numeric(_lineitem_cents(spark, d), _LI_NUM)


_TEXT_SQL = """SELECT '{c}' AS column, (SELECT count({c}) FROM {t}) AS count,
  (SELECT count(DISTINCT {c}) FROM {t}) AS unique,
  (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
  (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq"""


@register("describe_text", _union_sql([_TEXT_SQL.format(c=c, t=GAPPED)
                                       for c in ("o_orderstatus", "o_orderpriority")]))
def q_describe_text(spark, d):
    return profile.describe_text(gapped_orders(spark, d))


_EVERY = {"o_orderkey": "o_orderkey", "o_orderpriority": "o_orderpriority", "o_orderdate": "o_orderdate", "day": "CAST(o_orderdate AS DATE)",
          "final": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus = 'F' END", "nothing": "CAST(NULL AS BOOLEAN)"}
_EVERY_KIND = ["numeric", "text", "datetime", "datetime", "boolean", "boolean"]


def _every_sql(i, c, e, kind):
    t = f"(SELECT {e} AS x FROM {GAPPED})"
    named = kind != "numeric"
    top = f"(SELECT CAST(x AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE x IS NOT NULL GROUP BY x ORDER BY n DESC, v LIMIT 1)"
    sized = kind in ("numeric", "datetime")
    return (f"SELECT {i} AS position, '{c}' AS column, '{kind}' AS type_class, count(x) AS count, "
            + (f"count(DISTINCT x) AS unique, (SELECT v FROM {top}) AS top, (SELECT n FROM {top}) AS freq, " if named else
               "CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, ")
            + (f"CAST(min(x) AS VARCHAR) AS min, CAST(max(x) AS VARCHAR) AS max FROM {t}" if sized else f"CAST(NULL AS VARCHAR) AS min, CAST(NULL AS VARCHAR) AS max FROM {t}"))


@register("describe_all", " UNION ALL ".join(_every_sql(i, c, e, k) for i, ((c, e), k) in enumerate(zip(_EVERY.items(), _EVERY_KIND, strict=True))))
def q_describe_all(spark, d):
    return profile.describe_all(gapped_orders(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in _EVERY.items()]))


@register("column_profile", f"""
SELECT 'o_totalprice' AS column, 'double' AS dtype, count(DISTINCT o_totalprice) AS distinct,
  count(*) - count(o_totalprice) AS nulls, {_r("100.0 * (count(*) - count(o_totalprice)) / count(*)", 1)} AS null_pct,
  count(*) AS rows, count(o_totalprice) AS count, {_r("avg(o_totalprice)", 6)} AS mean,
  {_r("stddev_samp(o_totalprice)", 6)} AS std, min(o_totalprice) AS min,
  (SELECT q0 FROM {_qsql(GAPPED, "o_totalprice", [0.25])}) AS p25,
  (SELECT q0 FROM {_qsql(GAPPED, "o_totalprice", [0.5])}) AS p50,
  (SELECT q0 FROM {_qsql(GAPPED, "o_totalprice", [0.75])}) AS p75, max(o_totalprice) AS max
FROM {GAPPED}""")
def q_column_profile(spark, d):
    out = profile.column_profile(gapped_orders(spark, d), "o_totalprice")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@register("column_top_values", f"""
SELECT o_orderpriority, count(*) AS count FROM {GAPPED} WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority ORDER BY count DESC, o_orderpriority LIMIT 10""")
def q_column_top_values(spark, d):
    return profile.top_values(gapped_orders(spark, d), "o_orderpriority", 10)


@register("column_samples", f"""
SELECT o_totalprice FROM {GAPPED} WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice LIMIT 10""")
def q_column_samples(spark, d):
    return profile.samples(gapped_orders(spark, d), "o_totalprice", 10)


@register("schema_map", _union_sql([
    f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, '{k}' AS type_class, "
    f"count(DISTINCT {c}) AS distinct, count(*) - count({c}) AS missing, "
    f"{_r(f'100.0 * (count(*) - count({c})) / count(*)', 1)} AS missing_pct, "
    + (f"{_r(f'CAST(min({c}) AS DOUBLE)', 2)} AS min, {_r(f'CAST(max({c}) AS DOUBLE)', 2)} AS max, "
       f"{_r(f'avg({c})', 2)} AS mean " if k == "numeric" else
       "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean ")
    + f"FROM {GAPPED}"
    for i, (c, t, k) in enumerate(_GAPPED_TYPES)]))
def q_schema_map(spark, d):
    return profile.schema_map(gapped_orders(spark, d))


@register("completeness", f"""
SELECT count(*) AS rows, 6 AS columns, count(*) * 6 AS cells,
  count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice)
    + count(o_orderdate) + count(o_orderpriority) AS non_null_cells,
  {_r("100.0 * (count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority)) / (count(*) * 6)", 2)} AS completeness_pct
FROM {GAPPED}""")
def q_completeness(spark, d):
    return profile.completeness(gapped_orders(spark, d))


# ---------------------------------------------------------------- O1-O6: outliers (events.value)
def _event_values(spark, d):
    return load(spark, d, "events").select("event_id", _cents("value"))


_EV = f"""v AS (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT count(x) AS n, {_mean_sql('x')} AS m, {_std_sql('x')} AS sd,
             CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi,
             (SELECT q0 FROM {_qsql('v', 'x', [0.25])}) AS q1, (SELECT q0 FROM {_qsql('v', 'x', [0.75])}) AS q3 FROM v),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lb, q3 + 1.5 * (q3 - q1) AS ub FROM s),
z AS (SELECT CAST(x AS DOUBLE) AS value, abs(CAST(x AS DOUBLE) - m) AS dev FROM v, f
      WHERE abs((CAST(x AS DOUBLE) - m) / sd) > 3),
q AS (SELECT CAST(x AS DOUBLE) AS value, greatest(lb - CAST(x AS DOUBLE), CAST(x AS DOUBLE) - ub) AS dev
      FROM v, f WHERE CAST(x AS DOUBLE) < lb OR CAST(x AS DOUBLE) > ub)"""


@register("outlier_stats", f"""
WITH {_EV}
SELECT 'value' AS column, n AS count, {_r('m', 3)} AS mean, {_r('sd', 3)} AS std,
       {_r('lo', 3)} AS min, {_r('hi', 3)} AS max FROM f""")
def q_outlier_stats(spark, d):
    return outliers.outlier_stats(_event_values(spark, d), "value")


@register("outliers_zscore", f"""
WITH {_EV}, a AS (SELECT count(*) AS c, min(value) AS mn, max(value) AS mx FROM z)
SELECT 'value' AS column, 'zscore' AS method, n AS count, {_r('m', 3)} AS mean, {_r('sd', 3)} AS std,
       c AS outliers, {_r('100.0 * c / n', 2)} AS outlier_pct, {_r('mn', 3)} AS range_min,
       {_r('mx', 3)} AS range_max FROM f, a""")
def q_outliers_zscore(spark, d):
    return outliers.zscore_outliers(_event_values(spark, d), "value")


@register("outliers_iqr", f"""
WITH {_EV}, a AS (SELECT count(*) AS c, min(value) AS mn, max(value) AS mx FROM q)
SELECT 'value' AS column, 'iqr' AS method, n AS count, {_r('q1', 3)} AS q1, {_r('q3', 3)} AS q3,
       {_r('iqr', 3)} AS iqr, {_r('lb', 3)} AS lower_bound, {_r('ub', 3)} AS upper_bound,
       c AS outliers, {_r('100.0 * c / n', 2)} AS outlier_pct, {_r('mn', 3)} AS range_min,
       {_r('mx', 3)} AS range_max FROM f, a""")
def q_outliers_iqr(spark, d):
    return outliers.iqr_outliers(_event_values(spark, d), "value")


@register("outlier_range", f"""
WITH {_EV}
SELECT * FROM (
  SELECT 'zscore' AS method, count(*) AS outliers, {_r('min(value)', 3)} AS range_min, {_r('max(value)', 3)} AS range_max FROM z
  UNION ALL
  SELECT 'iqr' AS method, count(*) AS outliers, {_r('min(value)', 3)} AS range_min, {_r('max(value)', 3)} AS range_max FROM q
) WHERE outliers > 0""")
def q_outlier_range(spark, d):
    return outliers.outlier_range(_event_values(spark, d), "value", "both")


@register("outlier_samples", f"""
WITH {_EV},
zr AS (SELECT 'zscore' AS method, CAST(row_number() OVER (ORDER BY dev DESC, value) AS INTEGER) AS rank, value,
              count(*) OVER () AS c FROM z),
qr AS (SELECT 'iqr' AS method, CAST(row_number() OVER (ORDER BY dev DESC, value) AS INTEGER) AS rank, value,
              count(*) OVER () AS c FROM q)
SELECT method, rank, value FROM zr WHERE rank <= CASE WHEN c <= 10 THEN c ELSE 5 END
UNION ALL
SELECT method, rank, value FROM qr WHERE rank <= CASE WHEN c <= 10 THEN c ELSE 5 END""")
def q_outlier_samples(spark, d):
    return outliers.outlier_samples(_event_values(spark, d), "value", "both")


@register("outlier_summary", f"""
WITH {_EV}, a AS (SELECT (SELECT count(*) FROM z) AS zc, (SELECT count(*) FROM q) AS qc)
SELECT 'value' AS column, 'both' AS method, zc AS z_outliers, qc AS iqr_outliers,
       zc + qc > 0 AS any_outliers,
       CASE WHEN zc + qc > 0 THEN '{outliers.VERDICT_FOUND}' ELSE '{outliers.VERDICT_NONE}' END AS verdict
FROM a""")
def q_outlier_summary(spark, d):
    return outliers.outlier_summary(_event_values(spark, d), "value", "both")


@register("outlier_flags", f"""
WITH {_EV}
SELECT e.event_id, CAST(CAST(e.value AS DECIMAL(18,2)) AS DOUBLE) AS value,
  CASE WHEN e.value IS NULL THEN NULL ELSE abs((CAST(CAST(e.value AS DECIMAL(18,2)) AS DOUBLE) - m) / sd) > 3 END AS is_z_outlier,
  CASE WHEN e.value IS NULL THEN NULL ELSE CAST(CAST(e.value AS DECIMAL(18,2)) AS DOUBLE) < lb
       OR CAST(CAST(e.value AS DECIMAL(18,2)) AS DOUBLE) > ub END AS is_iqr_outlier
FROM events e, f""")
def q_outlier_flags(spark, d):
    out = outliers.outlier_flags(_event_values(spark, d), "value")
    return out.withColumn("value", F.col("value").cast("double"))


# ---------------------------------------------------------------- C1-C5: cleaning
# Columns of the gapped orders view without the unique keys, so that full-row
# duplicates occur (rows with a missing price), plus padded text.
_CLEAN_SRC = f"(SELECT o_orderstatus, o_totalprice, o_orderpriority FROM {GAPPED})"
_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _clean_src(spark, d):
    return gapped_orders(spark, d).select("o_orderstatus", "o_totalprice", "o_orderpriority")


_CLEANED = f"""d AS (SELECT DISTINCT * FROM {_CLEAN_SRC}),
t AS (SELECT {_TRIM.format(c="o_orderstatus")} AS o_orderstatus, o_totalprice,
             {_TRIM.format(c="o_orderpriority")} AS o_orderpriority FROM d),
med AS (SELECT q0 AS m FROM {_qsql('t', 'o_totalprice', [0.5])}),
mo AS (SELECT o_orderpriority AS v, count(*) AS c FROM t WHERE o_orderpriority IS NOT NULL
       GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)"""


@register("clean_dedupe", f"SELECT DISTINCT * FROM {_CLEAN_SRC}")
def q_clean_dedupe(spark, d):
    return clean.dedupe(_clean_src(spark, d))


@register("clean_trim", f"""
SELECT o_orderkey, {_TRIM.format(c="o_orderstatus")} AS o_orderstatus,
       {_TRIM.format(c="o_orderpriority")} AS o_orderpriority FROM {GAPPED}""")
def q_clean_trim(spark, d):
    return clean.trim_text(gapped_orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@register("clean_fill_median", f"""
SELECT o_orderkey, coalesce(o_totalprice, (SELECT q0 FROM {_qsql(GAPPED, 'o_totalprice', [0.5])})) AS o_totalprice
FROM {GAPPED}""")
def q_clean_fill_median(spark, d):
    return clean.fill_median(gapped_orders(spark, d).select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@register("clean_fill_mode", f"""
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {GAPPED} WHERE o_orderpriority IS NOT NULL
  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
FROM {GAPPED}""")
def q_clean_fill_mode(spark, d):
    return clean.fill_mode(gapped_orders(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register("quick_clean", f"""
WITH {_CLEANED}
SELECT o_orderstatus, coalesce(o_totalprice, (SELECT m FROM med)) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT v FROM mo)) AS o_orderpriority FROM t""")
def q_quick_clean(spark, d):
    return clean.quick_clean(_clean_src(spark, d))


@register("clean_report", f"""
WITH {_CLEANED},
n AS (SELECT (SELECT count(*) FROM {_CLEAN_SRC}) AS before, (SELECT count(*) FROM d) AS after),
steps AS (
  SELECT 1 AS k, 'dedupe' AS operation, CAST(NULL AS VARCHAR) AS column, before - after AS affected,
         CAST(NULL AS VARCHAR) AS fill_value FROM n WHERE before <> after
  UNION ALL SELECT 2, 'trim', 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus <> {_TRIM.format(c="o_orderstatus")}), NULL FROM d
  UNION ALL SELECT 3, 'trim', 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority <> {_TRIM.format(c="o_orderpriority")}), NULL FROM d
  UNION ALL SELECT 4, 'fill_median', 'o_totalprice', count(*) - count(o_totalprice), (SELECT CAST(m AS VARCHAR) FROM med) FROM t
  UNION ALL SELECT 5, 'fill_mode', 'o_orderpriority', count(*) - count(o_orderpriority), (SELECT v FROM mo) FROM t)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS step_no, operation, "column", affected, fill_value,
       before AS rows_before, after AS rows_after FROM steps, n""")
def q_clean_report(spark, d):
    return clean.clean_report(_clean_src(spark, d))


# ---------------------------------------------------------------- T1-T13: trends
# Text view of orders: ISO and month-first dates, unparsable dates and numbers.
_MESSY_SPARK = {
    "o_orderkey": "o_orderkey",
    "d_text": "CASE WHEN o_orderkey % 13 = 0 THEN 'bad' WHEN o_orderkey % 3 = 0 "
              "THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END",
    "v_text": "CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END",
}
MESSY = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'bad' WHEN o_orderkey % 3 = 0 "
         "THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_text, "
         "CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS v_text FROM orders)")


def messy_orders(spark, d):
    return load(spark, d, "orders").select(*[F.expr(e).alias(c) for c, e in _MESSY_SPARK.items()])


_STRP = {"yyyy/MM/dd": "%Y/%m/%d", "MM/dd/yyyy": "%m/%d/%Y", "dd-MM-yyyy": "%d-%m-%Y",
         "dd.MM.yyyy": "%d.%m.%Y", "yyyyMMdd": "%Y%m%d", "yyyy/MM/dd HH:mm:ss": "%Y/%m/%d %H:%M:%S",
         "MM/dd/yyyy HH:mm:ss": "%m/%d/%Y %H:%M:%S", "dd-MM-yyyy HH:mm:ss": "%d-%m-%Y %H:%M:%S",
         "d-MMM-yyyy": "%d-%b-%Y", "d MMM yyyy": "%d %b %Y", "MMM d, yyyy": "%b %d, %Y",
         "d-MMMM-yyyy": "%d-%B-%Y", "d MMMM yyyy": "%d %B %Y", "MMMM d, yyyy": "%B %d, %Y"}


def _parse_date_sql(c):
    return ("coalesce(TRY_CAST({c} AS TIMESTAMP), ".format(c=c)
            + ", ".join(f"try_strptime({c}, '{_STRP[f]}')" for f in trend.DATE_FORMATS) + ")")


_LABEL = {"D": "strftime({t}, '%Y-%m-%d')", "M": "strftime({t}, '%Y-%m')",
          "Q": "concat(year({t}), 'Q', quarter({t}))", "Y": "CAST(year({t}) AS VARCHAR)"}


def _valid_sql(src, dcol, vcol):
    return f"(SELECT {dcol} AS ts, {vcol} AS x FROM {src} WHERE {dcol} IS NOT NULL AND {vcol} IS NOT NULL)"


_ORD_VALID = _valid_sql("orders", "o_orderdate", "CAST(o_totalprice AS DECIMAL(18,2))")
_EV_VALID = _valid_sql("events", "ts", "CAST(value AS DECIMAL(18,2))")
_MESSY_VALID = (f"(SELECT * FROM (SELECT {_parse_date_sql('d_text')} AS ts, "
                f"TRY_CAST(v_text AS DECIMAL(18,2)) AS x FROM {MESSY}) WHERE ts IS NOT NULL AND x IS NOT NULL)")


def _totals_sql(valid, freq):
    return (f"(SELECT {_LABEL[freq].format(t='ts')} AS period, round(sum(x), 2) AS sum, "
            f"{_r('CAST(sum(x) AS DOUBLE) / count(x)', 2)} AS mean, count(x) AS count FROM {valid} GROUP BY 1)")


def _totals_out(t):
    return t.select("period", F.col("sum").cast("double").alias("sum"), "mean", "count")


def _orders_totals(spark, d, freq="M"):
    o = load(spark, d, "orders").select("o_orderdate", _cents("o_totalprice"))
    return trend.period_totals(o, "o_orderdate", "o_totalprice", freq)


@register("coerce_dates", f"""
SELECT o_orderkey, strftime(ts, '%Y-%m-%d') AS d FROM (SELECT o_orderkey, {_parse_date_sql('d_text')} AS ts FROM {MESSY})
WHERE ts IS NOT NULL""")
def q_coerce_dates(spark, d):
    out = trend.coerce_dates(messy_orders(spark, d).select("o_orderkey", "d_text"), "d_text")
    return out.select("o_orderkey", F.date_format("d_text", "yyyy-MM-dd").alias("d"))


@register("coerce_dates_months", f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderkey % 5 < 4 AND o_orderdate IS NOT NULL""")
def q_coerce_dates_months(spark, d):
    """Dates with the month's name, short and whole, in four layouts; the fifth is no date and is dropped."""
    o = load(spark, d, "orders")
    forms = [F.date_format("o_orderdate", f) for f in ("dd-MMM-yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy")] + [F.lit("Smarch 13, 1995")]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    out = trend.coerce_dates(o.select("o_orderkey", text.alias("d_text")), "d_text")
    return out.select("o_orderkey", F.date_format("d_text", "yyyy-MM-dd").alias("d"))


@register("coerce_numbers", f"""
SELECT o_orderkey, v FROM (SELECT o_orderkey, TRY_CAST(v_text AS DOUBLE) AS v FROM {MESSY})
WHERE v IS NOT NULL AND NOT isnan(v)""")
def q_coerce_numbers(spark, d):
    out = trend.coerce_numbers(messy_orders(spark, d).select("o_orderkey", "v_text"), "v_text")
    return out.select("o_orderkey", F.col("v_text").alias("v"))


for _freq, _key in (("M", "trend_month"), ("Q", "trend_quarter"), ("Y", "trend_year")):
    register(_key, f"SELECT period, CAST(sum AS DOUBLE) AS sum, mean, count FROM {_totals_sql(_ORD_VALID, _freq)}")(
        lambda spark, d, _f=_freq: _totals_out(_orders_totals(spark, d, _f)))


@register("trend_day", f"SELECT period, CAST(sum AS DOUBLE) AS sum, mean, count FROM {_totals_sql(_EV_VALID, 'D')}")
def q_trend_day(spark, d):
    e = load(spark, d, "events").select("ts", _cents("value"))
    return _totals_out(trend.period_totals(e, "ts", "value", "D"))


@register("trend_range", f"""
SELECT strftime(min(ts), '%Y-%m-%d') AS date_from, strftime(max(ts), '%Y-%m-%d') AS date_to,
       count(DISTINCT {_LABEL['M'].format(t='ts')}) AS periods FROM {_MESSY_VALID}""")
def q_trend_range(spark, d):
    return trend.trend_range(messy_orders(spark, d), "d_text", "v_text", "M", to="decimal(18,2)")


_TM = _totals_sql(_ORD_VALID, "M")


@register("trend_recent_periods", f"""
SELECT period, CAST(sum AS DOUBLE) AS sum, mean, count FROM {_TM} ORDER BY period DESC LIMIT 20""")
def q_trend_recent_periods(spark, d):
    return _totals_out(trend.recent_periods(_orders_totals(spark, d), 20))


@register("trend_summary", f"""
SELECT count(sum) AS periods, CAST(sum(sum) AS DOUBLE) AS total, {_r(_mean_sql('sum'), 2)} AS mean,
       {_r(_std_sql('sum'), 2)} AS std, {_r(f"100.0 * ({_std_sql('sum')}) / ({_mean_sql('sum')})", 1)} AS cv_pct
FROM {_TM}""")
def q_trend_summary(spark, d):
    return trend.trend_summary(_orders_totals(spark, d))


_GROWTH = f"""g AS (SELECT period, sum, lag(sum) OVER (ORDER BY period) AS prev_sum,
  row_number() OVER (ORDER BY period) AS ord, count(*) OVER () AS n FROM {_TM}),
gg AS (SELECT *, CAST(sum - prev_sum AS DOUBLE) / CAST(NULLIF(prev_sum, 0) AS DOUBLE) * 100.0 AS gr FROM g)"""


@register("trend_growth", f"""
WITH {_GROWTH}
SELECT period, CAST(sum AS DOUBLE) AS sum, CAST(prev_sum AS DOUBLE) AS prev_sum, {_r('gr', 2)} AS growth_pct
FROM gg WHERE n >= 3""")
def q_trend_growth(spark, d):
    g = trend.growth(_orders_totals(spark, d))
    return g.select("period", F.col("sum").cast("double").alias("sum"),
                    F.col("prev_sum").cast("double").alias("prev_sum"), "growth_pct")


_OVERALL = "CAST(last_sum - first_sum AS DOUBLE) / CAST(NULLIF(first_sum, 0) AS DOUBLE) * 100.0"


@register("trend_direction", f"""
WITH {_GROWTH},
a AS (SELECT count(*) AS periods, arg_min(sum, ord) AS first_sum, arg_max(sum, ord) AS last_sum, avg(gr) AS ag FROM gg)
SELECT periods, CAST(first_sum AS DOUBLE) AS first_sum, CAST(last_sum AS DOUBLE) AS last_sum,
  {_r('ag', 2)} AS avg_growth_pct, {_r(_OVERALL, 2)} AS overall_growth_pct,
  CASE WHEN first_sum = 0 THEN (CASE WHEN last_sum > first_sum THEN '{trend.STRONG_UP}'
                                     WHEN last_sum < first_sum THEN '{trend.STRONG_DOWN}' ELSE '{trend.FLAT}' END)
       WHEN {_OVERALL} > 10 THEN '{trend.STRONG_UP}' WHEN {_OVERALL} > 2 THEN '{trend.MODERATE_UP}'
       WHEN {_OVERALL} < -10 THEN '{trend.STRONG_DOWN}' WHEN {_OVERALL} < -2 THEN '{trend.MODERATE_DOWN}'
       ELSE '{trend.FLAT}' END AS direction
FROM a WHERE periods >= 3""")
def q_trend_direction(spark, d):
    return trend.direction(_orders_totals(spark, d))


@register("trend_peaks", f"""
WITH t AS (SELECT * FROM {_TM}), c AS (SELECT count(*) AS n FROM t)
SELECT (SELECT period FROM t ORDER BY sum DESC, period LIMIT 1) AS highest_period,
       (SELECT CAST(max(sum) AS DOUBLE) FROM t) AS highest_sum,
       (SELECT period FROM t ORDER BY sum, period LIMIT 1) AS lowest_period,
       (SELECT CAST(min(sum) AS DOUBLE) FROM t) AS lowest_sum
FROM c WHERE n >= 3""")
def q_trend_peaks(spark, d):
    return trend.peaks(_orders_totals(spark, d))


_RECENT_SQL = f"""l AS (SELECT * FROM {{tm}} ORDER BY period DESC LIMIT 6),
b AS (SELECT count(*) AS k, min(period) AS first_period, max(period) AS last_period,
             arg_min(sum, period) AS fs, arg_max(sum, period) AS ls FROM l),
c AS (SELECT *, CAST(ls - fs AS DOUBLE) / CAST(NULLIF(fs, 0) AS DOUBLE) * 100.0 AS ch FROM b)"""


@register("trend_recent_direction", f"""
WITH {_RECENT_SQL.format(tm=_TM)}
SELECT first_period, last_period, {_r('ch', 2)} AS change_pct,
  CASE WHEN ch > 5 THEN '{trend.ACCELERATING}' WHEN ch < -5 THEN '{trend.DECLINING}' ELSE '{trend.STABLE}' END AS direction
FROM c WHERE k >= 6""")
def q_trend_recent_direction(spark, d):
    return trend.recent_direction(_orders_totals(spark, d))


_QUALITY_SQL = f"""qa AS (SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE {_parse_date_sql('d_text')} IS NOT NULL AND TRY_CAST(v_text AS DECIMAL(18,2)) IS NOT NULL) AS valid_rows
  FROM {MESSY})"""


@register("trend_quality", f"""
WITH {_QUALITY_SQL}
SELECT total_rows, valid_rows, {_r('100.0 * valid_rows / total_rows', 1)} AS completeness_pct,
       100.0 * valid_rows / total_rows < 90 AS low_completeness FROM qa""")
def q_trend_quality(spark, d):
    return trend.trend_quality(messy_orders(spark, d), "d_text", "v_text", to="decimal(18,2)")


def _pf(x, d=2):
    return f"printf('%.{d}f', {x})"


@register("trend_report", f"""
WITH v AS {_MESSY_VALID}, tm AS {_totals_sql('v', 'M')},
{_GROWTH.replace(_TM, 'tm')},
a AS (SELECT count(*) AS periods, arg_min(sum, ord) AS first_sum, arg_max(sum, ord) AS last_sum, avg(gr) AS ag FROM gg),
{_RECENT_SQL.format(tm='tm')},
{_QUALITY_SQL},
sm AS (SELECT count(sum) AS periods, CAST(sum(sum) AS DOUBLE) AS total, {_mean_sql('sum')} AS m, {_std_sql('sum')} AS sd FROM tm)
SELECT 'range' AS section, 'date_from' AS metric, strftime(min(ts), '%Y-%m-%d') AS value FROM v
UNION ALL SELECT 'range', 'date_to', strftime(max(ts), '%Y-%m-%d') FROM v
UNION ALL SELECT 'range', 'periods', CAST(count(DISTINCT {_LABEL['M'].format(t='ts')}) AS VARCHAR) FROM v
UNION ALL SELECT * FROM (SELECT 'recent_periods', period, {_pf('CAST(sum AS DOUBLE)')} || ' | ' || {_pf('mean')} || ' | ' || CAST(count AS VARCHAR)
                         FROM tm ORDER BY period DESC LIMIT 20)
UNION ALL SELECT 'summary', 'total', {_pf('total')} FROM sm
UNION ALL SELECT 'summary', 'mean_per_period', {_pf(_r('m', 2))} FROM sm
UNION ALL SELECT 'summary', 'std', {_pf(_r('sd', 2))} FROM sm
UNION ALL SELECT 'summary', 'cv_pct', {_pf(_r('100.0 * sd / m', 1), 1)} FROM sm
UNION ALL SELECT 'growth', 'avg_growth_pct', {_pf(_r('ag', 2))} FROM a WHERE periods >= 3
UNION ALL SELECT 'growth', 'overall_growth_pct', {_pf(_r(_OVERALL, 2))} FROM a WHERE periods >= 3
UNION ALL SELECT 'growth', 'direction',
  CASE WHEN first_sum = 0 THEN (CASE WHEN last_sum > first_sum THEN '{trend.STRONG_UP}'
                                     WHEN last_sum < first_sum THEN '{trend.STRONG_DOWN}' ELSE '{trend.FLAT}' END)
       WHEN {_OVERALL} > 10 THEN '{trend.STRONG_UP}' WHEN {_OVERALL} > 2 THEN '{trend.MODERATE_UP}'
       WHEN {_OVERALL} < -10 THEN '{trend.STRONG_DOWN}' WHEN {_OVERALL} < -2 THEN '{trend.MODERATE_DOWN}'
       ELSE '{trend.FLAT}' END FROM a WHERE periods >= 3
UNION ALL SELECT 'peaks', 'highest_period', (SELECT period FROM tm ORDER BY sum DESC, period LIMIT 1) FROM a WHERE periods >= 3
UNION ALL SELECT 'peaks', 'highest_sum', (SELECT {_pf('CAST(max(sum) AS DOUBLE)')} FROM tm) FROM a WHERE periods >= 3
UNION ALL SELECT 'peaks', 'lowest_period', (SELECT period FROM tm ORDER BY sum, period LIMIT 1) FROM a WHERE periods >= 3
UNION ALL SELECT 'peaks', 'lowest_sum', (SELECT {_pf('CAST(min(sum) AS DOUBLE)')} FROM tm) FROM a WHERE periods >= 3
UNION ALL SELECT 'recent', 'change_pct', {_pf(_r('ch', 2))} FROM c WHERE k >= 6
UNION ALL SELECT 'recent', 'direction', CASE WHEN ch > 5 THEN '{trend.ACCELERATING}' WHEN ch < -5 THEN '{trend.DECLINING}'
                                            ELSE '{trend.STABLE}' END FROM c WHERE k >= 6
UNION ALL SELECT 'quality', 'total_rows', CAST(total_rows AS VARCHAR) FROM qa
UNION ALL SELECT 'quality', 'valid_rows', CAST(valid_rows AS VARCHAR) FROM qa
UNION ALL SELECT 'quality', 'completeness_pct', {_pf(_r('100.0 * valid_rows / total_rows', 1), 1)} FROM qa
UNION ALL SELECT 'quality', 'low_completeness', CAST(100.0 * valid_rows / total_rows < 90 AS VARCHAR) FROM qa""")
def q_trend_report(spark, d):
    return trend.trend_report(messy_orders(spark, d), "d_text", "v_text", "M", to="decimal(18,2)")


# ---------------------------------------------------------------- A3, A4: correlations
_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(a, b):
    x, y = f"CAST({a} AS DECIMAL(18,2))", f"CAST({b} AS DECIMAL(18,2))"
    n = "count(*)"
    cov = f"CAST({n} * sum({x} * {y}) - sum({x}) * sum({y}) AS DOUBLE)"
    vx = f"CAST({n} * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE)"
    vy = f"CAST({n} * sum({y} * {y}) - sum({y}) * sum({y}) AS DOUBLE)"
    return f"{cov} / NULLIF(sqrt({vx}) * sqrt({vy}), 0)"


_CORR_ROWS = []
for _i, _a in enumerate(_CORR_COLS):
    for _j, _b in enumerate(_CORR_COLS):
        _e = (f"CASE WHEN stddev_samp({_a}) > 0 THEN 1.0 END" if _i == _j
              else _corr_sql(_CORR_COLS[min(_i, _j)], _CORR_COLS[max(_i, _j)]))
        _CORR_ROWS.append((_i, _j, _a, _b, _e))


@register("correlation_matrix", _union_sql([
    f"SELECT '{a}' AS col_x, '{b}' AS col_y, {i} AS ix, {j} AS iy, CAST({e} AS DOUBLE) AS r FROM lineitem"
    for i, j, a, b, e in _CORR_ROWS]))
def q_correlation_matrix(spark, d):
    return stats.correlation_matrix(_lineitem_cents(spark, d), _CORR_COLS)


_PART_CORR = ["p_partkey", "p_size", "p_retailprice"]


def _corr_sql_any(a, b, exact):
    x, y = exact[a], exact[b]
    cov = f"CAST(count(*) * sum({x} * {y}) - sum({x}) * sum({y}) AS DOUBLE)"
    vx = f"CAST(count(*) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE)"
    vy = f"CAST(count(*) * sum({y} * {y}) - sum({y}) * sum({y}) AS DOUBLE)"
    return f"{cov} / NULLIF(sqrt({vx}) * sqrt({vy}), 0)"


_PART_EXACT = {"p_partkey": "CAST(p_partkey AS DECIMAL(38,0))", "p_size": "CAST(p_size AS DECIMAL(38,0))",
               "p_retailprice": "CAST(p_retailprice AS DECIMAL(18,2))"}


@register("strong_correlations", "SELECT col_x, col_y, r FROM (" + _union_sql([
    f"SELECT '{a}' AS col_x, '{b}' AS col_y, {_r(_corr_sql_any(a, b, _PART_EXACT), 3)} AS r, "
    f"abs({_corr_sql_any(a, b, _PART_EXACT)}) AS ar FROM part"
    for i, a in enumerate(_PART_CORR) for b in _PART_CORR[i + 1:]]) + ") WHERE ar > 0.5")
def q_strong_correlations(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size", _cents("p_retailprice"))
    return stats.strong_correlations(p, _PART_CORR)


_SIGNED = {"up": "l_linenumber", "up2": "l_linenumber * 2 + l_orderkey % 2", "down": "l_partkey % 2 - l_linenumber * 3", "flat": "7",
           "gaps": "CASE WHEN l_orderkey % 3 > 0 THEN l_linenumber * 5 + l_suppkey % 3 END", "other": "l_partkey % 101"}
_SIGNED_TABLE = "(SELECT " + ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in _SIGNED.items()) + " FROM lineitem)"


def _signed_sql(x, y):
    a, b = f"CAST({x} AS DECIMAL(38,0))", f"CAST({y} AS DECIMAL(38,0))"
    co = lambda p, q: f"CAST(count(*) * sum({p} * {q}) - sum({p}) * sum({q}) AS DOUBLE)"
    return (f"SELECT '{x}' AS col_x, '{y}' AS col_y, {co(a, b)} / NULLIF(sqrt({co(a, a)}) * sqrt({co(b, b)}), 0) AS r "
            f"FROM {_SIGNED_TABLE} WHERE {x} IS NOT NULL AND {y} IS NOT NULL")


@register("strong_correlations_signed", f"SELECT col_x, col_y, {_r('r', 3)} AS r FROM (" + " UNION ALL ".join(
    _signed_sql(x, y) for i, x in enumerate(_SIGNED) for y in list(_SIGNED)[i + 1:]) + ") WHERE abs(r) > 0.5")
def q_strong_correlations_signed(spark, d):
    """Pairs above 0.5, below -0.5 and without a correlation (a constant column)."""
    return stats.strong_correlations(load(spark, d, "lineitem").selectExpr(*[f"CAST({e} AS BIGINT) AS {c}" for c, e in _SIGNED.items()]))


# ---------------------------------------------------------------- V1-V7: chart data
@register("chart_bar_count", """
SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL
GROUP BY source ORDER BY count DESC, source LIMIT 20""")
def q_chart_bar_count(spark, d):
    return chartdata.bar(load(spark, d, "documents"), "source")


@register("chart_bar_sum", """
SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM orders
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY o_orderpriority ORDER BY sum DESC, o_orderpriority LIMIT 15""")
def q_chart_bar_sum(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", _cents("o_totalprice"))
    out = chartdata.bar(o, "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", F.col("sum").cast("double").alias("sum"))


@register("chart_pie", f"""
WITH t AS (SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_mktsegment IS NOT NULL
           GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 10)
SELECT c_mktsegment, count, {_r('100.0 * count / (SELECT sum(count) FROM t)', 1)} AS share_pct FROM t""")
def q_chart_pie(spark, d):
    return chartdata.pie(load(spark, d, "customer"), "c_mktsegment", 10)


@register("chart_bar_count_rows", """
SELECT source, count(*) AS count, (SELECT count(source) FROM documents) AS rows_used FROM documents WHERE source IS NOT NULL
GROUP BY source ORDER BY count DESC, source LIMIT 7""")
def q_chart_bar_count_rows(spark, d):
    return chartdata.bar(load(spark, d, "documents"), "source", n=7, rows_used=True)


@register("chart_bar_sum_rows", f"""
SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum,
  (SELECT count(*) FROM {GAPPED} WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL) AS rows_used FROM {GAPPED}
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY o_orderpriority ORDER BY sum DESC, o_orderpriority LIMIT 3""")
def q_chart_bar_sum_rows(spark, d):
    o = gapped_orders(spark, d).select("o_orderpriority", _cents("o_totalprice"))
    out = chartdata.bar(o, "o_orderpriority", "o_totalprice", n=3, rows_used=True)
    return out.select("o_orderpriority", F.col("sum").cast("double").alias("sum"), "rows_used")


@register("chart_pie_rows", f"""
WITH t AS (SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count DESC, lang LIMIT 3)
SELECT lang, count, {_r('100.0 * count / (SELECT sum(count) FROM t)', 1)} AS share_pct, (SELECT count(lang) FROM documents) AS rows_used FROM t""")
def q_chart_pie_rows(spark, d):
    return chartdata.pie(load(spark, d, "documents"), "lang", 3, rows_used=True)


@register("chart_line", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, m AS mean, sd AS std, n AS count,
       m - 1.96 * sd / sqrt(CAST(n AS DOUBLE)) AS ci_low, m + 1.96 * sd / sqrt(CAST(n AS DOUBLE)) AS ci_high
FROM (SELECT day, {_mean_sql('x')} AS m, {_std_sql('x')} AS sd, count(x) AS n
      FROM (SELECT CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS x FROM events
            WHERE ts IS NOT NULL AND value IS NOT NULL) GROUP BY day)""")
def q_chart_line(spark, d):
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), _cents("value"))
    out = chartdata.line(e, "day", "value")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("chart_scatter", """
SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def q_chart_scatter(spark, d):
    return chartdata.scatter(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


_EDGE = "CASE WHEN ({i}) >= 30 THEN hi ELSE CAST({i} AS DOUBLE) * step + lo END"


@register("chart_histogram", f"""
WITH r AS (SELECT min(value) AS lo0, max(value) AS hi0 FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
k AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r),
p AS (SELECT lo, hi, (hi - lo) / 30 AS step, 30 / (hi - lo) AS norm FROM k),
a AS (SELECT value AS v, p.* FROM events, p WHERE value IS NOT NULL),
b AS (SELECT *, CASE WHEN CAST(floor((v - lo) * norm) AS INTEGER) = 30 THEN 29
                     ELSE CAST(floor((v - lo) * norm) AS INTEGER) END AS i0 FROM a),
c AS (SELECT *, CASE WHEN v < {_EDGE.format(i='i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM b),
e AS (SELECT CASE WHEN v >= {_EDGE.format(i='i1 + 1')} AND i1 <> 29 THEN i1 + 1 ELSE i1 END + 1 AS bin FROM c),
cnt AS (SELECT bin, count(*) AS n FROM e GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, {_EDGE.format(i='g.bin - 1')} AS bin_low, {_EDGE.format(i='g.bin')} AS bin_high,
       coalesce(cnt.n, 0) AS count
FROM (SELECT unnest(range(1, 31)) AS bin) g CROSS JOIN p LEFT JOIN cnt ON cnt.bin = g.bin""")
def q_chart_histogram(spark, d):
    return chartdata.histogram(load(spark, d, "events"), "value", 30)


def _box_sql(src, by):
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""
WITH v AS ({src}),
q AS (SELECT {sel}q0 AS q1, q1 AS median, q2 AS q3 FROM {_qsql('v', 'x', [0.25, 0.5, 0.75], by)}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT {sel}count(x) AS count, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       any_value(iqr) AS iqr, any_value(lower_fence) AS lower_fence, any_value(upper_fence) AS upper_fence,
       min(x) FILTER (WHERE x >= lower_fence) AS whisker_low, max(x) FILTER (WHERE x <= upper_fence) AS whisker_high,
       count(*) FILTER (WHERE x < lower_fence OR x > upper_fence) AS n_outliers
FROM v JOIN f {join} {grp}"""


@register("chart_box", _box_sql("SELECT CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS x FROM events "
                                "WHERE value IS NOT NULL", None))
def q_chart_box(spark, d):
    return chartdata.box(load(spark, d, "events").select(_cents("value")), "value")


@register("chart_box_grouped", _box_sql(
    "SELECT o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS x FROM orders "
    "WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL", "o_orderpriority"))
def q_chart_box_grouped(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", _cents("o_totalprice"))
    return chartdata.box(o, "o_orderpriority", "o_totalprice")


# ---------------------------------------------------------------- X1, F4, F7: steps and filters
_STEPS = [
    {"op": "derive", "name": "o_year", "expr": "year(o_orderdate)"},
    {"op": "filter", "cond": "o_orderstatus = 'F'"},
    {"op": "cast", "col": "o_totalprice", "type": "decimal(18,2)"},
    {"op": "aggregate", "keys": ["o_year"],
     "exprs": {"n": "count(*)", "total": "CAST(sum(o_totalprice) AS DOUBLE)"}},
]


@register("apply_steps", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def q_apply_steps(spark, d):
    out, _ = steps.apply_steps(load(spark, d, "orders"), _STEPS, with_counts=False)
    return out


@register("drop_missing", f"""
SELECT * FROM {GAPPED} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q_drop_missing(spark, d):
    return steps.drop_missing(gapped_orders(spark, d), ["o_totalprice", "o_orderpriority"])


@register("filter_year_category", """
SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND o_orderstatus = 'F'""")
def q_filter_year_category(spark, d):
    o = load(spark, d, "orders")
    return steps.filter_year_category(o, "o_orderdate", 1997, "o_orderstatus", "F").select("o_orderkey", "o_totalprice")


def _sq(text):
    return "'" + text.replace("'", "''") + "'"


@register("audit_log", f"""
WITH n0 AS (SELECT count(*) AS c FROM orders),
     n1 AS (SELECT count(*) AS c FROM orders WHERE o_orderstatus = 'F'),
     n2 AS (SELECT count(DISTINCT year(o_orderdate)) AS c FROM orders WHERE o_orderstatus = 'F')
SELECT 1 AS step_no, 'derive' AS operation, {_sq('o_year = year(o_orderdate)')} AS detail,
       n0.c AS rows_before, n0.c AS rows_after FROM n0
UNION ALL SELECT 2, 'filter', {_sq("o_orderstatus = 'F'")}, n0.c, n1.c FROM n0, n1
UNION ALL SELECT 3, 'cast', {_sq('o_totalprice AS decimal(18,2)')}, n1.c, n1.c FROM n1
UNION ALL SELECT 4, 'aggregate', {_sq("by ['o_year']: " + repr(_STEPS[3]['exprs']))}, n1.c, n2.c FROM n1, n2""")
def q_audit_log(spark, d):
    _, audit = steps.apply_steps(load(spark, d, "orders"), _STEPS, with_counts=True)
    path = scratch_path(spark, "audit")
    sources.append_log(spark, audit, path)
    return sources.read_log(spark, path).drop("logged_at", "columns_before", "columns_after")


_ALL_VERBS = [
    {"op": "select", "cols": ["o_orderkey", "o_custkey", "o_orderstatus AS status", "o_totalprice", "o_orderpriority", "o_orderdate"]},
    {"op": "rename", "mapping": {"o_totalprice": "price", "o_orderpriority": "priority"}},
    {"op": "cast", "col": "price", "type": "decimal(18,2)"},
    {"op": "dropna", "subset": ["price"]},
    {"op": "fillna", "values": {"priority": "none"}},
    {"op": "replace", "col": "priority", "mapping": {"1-URGENT": "urgent", "5-LOW": "low"}},
    {"op": "derive", "name": "bucket", "expr": "o_custkey % 97"},
    {"op": "filter", "cond": "bucket < 90 AND priority <> 'low'"},
    {"op": "drop", "cols": ["o_custkey", "o_orderdate", "o_orderkey", "price"]},
    {"op": "dedupe"},
    {"op": "sort", "cols": ["bucket", "priority", "status"]},
    {"op": "limit", "n": 200},
    {"op": "aggregate", "keys": ["priority"], "exprs": {"n": "count(*)", "buckets": "count(DISTINCT bucket)"}},
]
_VERB_SQL = f"""
s4 AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CASE coalesce(o_orderpriority, 'none') WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE coalesce(o_orderpriority, 'none') END AS priority
       FROM {GAPPED} WHERE o_totalprice IS NOT NULL),
s8 AS (SELECT status, priority, o_custkey % 97 AS bucket FROM s4 WHERE o_custkey % 97 < 90 AND priority <> 'low'),
s10 AS (SELECT DISTINCT status, priority, bucket FROM s8),
s12 AS (SELECT * FROM s10 ORDER BY bucket, priority, status LIMIT 200),
s13 AS (SELECT priority, count(*) AS n, count(DISTINCT bucket) AS buckets FROM s12 GROUP BY priority)"""


@register("apply_all_verbs", f"WITH {_VERB_SQL} SELECT * FROM s13")
def q_apply_all_verbs(spark, d):
    return steps.apply_steps(gapped_orders(spark, d), _ALL_VERBS, with_counts=False)[0]


_VERB_ROWS = [(0, 0, 6, 6), (0, 0, 6, 6), (0, 0, 6, 6), (0, 4, 6, 6), (4, 4, 6, 6), (4, 4, 6, 6), (4, 4, 6, 7), (4, 8, 7, 7), (8, 8, 7, 3), (8, 10, 3, 3), (10, 10, 3, 3),
              (10, 12, 3, 3), (12, 13, 3, 3)]


@register("audit_all_verbs", f"WITH s0 AS (SELECT 1 FROM orders), {_VERB_SQL} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS step_no, '{step['op']}' AS operation, (SELECT count(*) FROM s{b}) AS rows_before, (SELECT count(*) FROM s{a}) AS rows_after, "
    f"{cb} AS columns_before, {ca} AS columns_after" for i, (step, (b, a, cb, ca)) in enumerate(zip(_ALL_VERBS, _VERB_ROWS, strict=True))))
def q_audit_all_verbs(spark, d):
    return steps.apply_steps(gapped_orders(spark, d), _ALL_VERBS)[1].drop("detail")


# ---------------------------------------------------------------- S1-S7, S10: sources and sinks
def _gapped_csv(spark, d):
    """Write the gapped orders as ';'-separated text with padded header names and
    'NA' for missing values; return the folder."""
    g = gapped_orders(spark, d)
    g = g.toDF(*[f" {c} " for c in g.columns])
    return sources.write_table(g, scratch_path(spark, "gapped"), "csv", sep=";", null_value="NA")


@register("csv_scan", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM {GAPPED}""")
def q_csv_scan(spark, d):
    return sources.read_delimited(spark, _gapped_csv(spark, d))


@register("normalize_headers", """
SELECT 0 AS position, 'o_orderkey' AS column UNION ALL SELECT 1, 'o_custkey'
UNION ALL SELECT 2, 'o_orderstatus' UNION ALL SELECT 3, 'o_totalprice' UNION ALL SELECT 4, 'o_orderdate'
UNION ALL SELECT 5, 'o_orderpriority'""")
def q_normalize_headers(spark, d):
    df = sources.read_delimited(spark, _gapped_csv(spark, d), infer=False)
    return sources.load_summary(df).select("position", "column")


_TOKEN_EXPR = ("CASE WHEN o_orderkey % 7 = 0 THEN 'nan' WHEN o_orderkey % 11 = 0 THEN 'N/A' "
               "WHEN o_orderkey % 13 = 0 THEN 'NULL' WHEN o_orderkey % 17 = 0 THEN '' "
               "ELSE CAST(o_totalprice AS STRING) END")


@register("null_tokens", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
                             OR o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def q_null_tokens(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.expr(_TOKEN_EXPR).alias("price"))
    path = sources.write_table(o, scratch_path(spark, "tokens"), "csv")
    return sources.read_delimited(spark, path)


_GAPPED_CSV_TYPES = """SELECT 0 AS position, 'o_orderkey' AS column, 'bigint' AS dtype, 'numeric' AS type_class
  UNION ALL SELECT 1, 'o_custkey', 'bigint', 'numeric' UNION ALL SELECT 2, 'o_orderstatus', 'string', 'text'
  UNION ALL SELECT 3, 'o_totalprice', 'double', 'numeric' UNION ALL SELECT 4, 'o_orderdate', 'string', 'text'
  UNION ALL SELECT 5, 'o_orderpriority', 'string', 'text'"""


@register("load_summary", f"""
SELECT position, "column", dtype, type_class, (SELECT count(*) FROM orders) AS rows FROM ({_GAPPED_CSV_TYPES})""")
def q_load_summary(spark, d):
    return sources.load_summary(sources.read_delimited(spark, _gapped_csv(spark, d)))


@register("load_files", "SELECT 1 AS files, count(*) + 1 AS lines, count(*) AS original_rows, 6 AS original_columns, true AS known FROM orders")
def q_load_files(spark, d):
    """One row for each input file of a load, here added up: names and sizes differ from run to run."""
    one = gapped_orders(spark, d).coalesce(1)
    path = sources.write_table(one, scratch_path(spark, "one-file"), "csv", sep=";", null_value="NA")
    f = sources.load_files(spark, path)
    whole = F.col("file_name").endswith(".csv") & F.col("file_path").contains("one-file") & (F.col("file_size") > 0) & (F.col("modified") <= F.col("loaded_at"))
    return f.groupBy("original_rows", "original_columns").agg(F.count("*").cast("int").alias("files"), F.sum("lines").alias("lines"), F.min(whole).alias("known"))


@register("load_first_rows", f"SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM {GAPPED} ORDER BY o_orderkey LIMIT 3")
def q_load_first_rows(spark, d):
    """The first three rows of a load whose one file was written in the order of o_orderkey."""
    g = gapped_orders(spark, d).orderBy("o_orderkey").coalesce(1)
    g = g.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    path = sources.write_table(g, scratch_path(spark, "first-rows"), "csv", sep=";", null_value="NA")
    return sources.head_rows(sources.read_delimited(spark, path), 3)


@register("columns_by_type", _GAPPED_CSV_TYPES)
def q_columns_by_type(spark, d):
    return profile.columns_by_type(sources.read_delimited(spark, _gapped_csv(spark, d)))


@register("profile_types", """
SELECT 0 AS position, 'l_returnflag' AS column, 'string' AS dtype, 'text' AS type_class
UNION ALL SELECT 1, 'l_linenumber', 'bigint', 'numeric' UNION ALL SELECT 2, 'l_discount', 'double', 'numeric'
UNION ALL SELECT 3, 'l_shipdate', 'string', 'text' UNION ALL SELECT 4, 'is_open', 'boolean', 'boolean'""")
def q_profile_types(spark, d):
    li = load(spark, d, "lineitem").select(
        "l_returnflag", "l_linenumber", "l_discount", "l_shipdate",
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END").alias("is_open"))
    path = sources.write_table(li, scratch_path(spark, "types"), "csv", sep="|")
    return profile.types(sources.read_delimited(spark, path))


@register("write_clean", f"""
WITH {_CLEANED}
SELECT o_orderstatus, coalesce(o_totalprice, (SELECT m FROM med)) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT v FROM mo)) AS o_orderpriority FROM t""")
def q_write_clean(spark, d):
    path = sources.write_table(clean.quick_clean(_clean_src(spark, d)), scratch_path(spark, "cleaned"), "csv")
    return sources.read_delimited(spark, path)


@register("count_written", f"""
SELECT count(*) AS rows FROM (SELECT DISTINCT * FROM {_CLEAN_SRC})""")
def q_count_written(spark, d):
    path = sources.write_table(clean.quick_clean(_clean_src(spark, d)), scratch_path(spark, "cleaned"), "csv")
    return sources.count_written(spark, path).select("rows")


@register("profile_json", _SQL["schema_map"])
def q_profile_json(spark, d):
    sm = profile.schema_map(gapped_orders(spark, d))
    path = sources.write_json(sm, scratch_path(spark, "schema_map"))
    return spark.read.schema(sm.schema).json(path)


_MISSING = {c: f"count(*) - count({c})" for c in _GAPPED_COLS}


@register("schema_json", f"""
SELECT 'orders' AS dataset_name, count(*) AS rows, '{','.join(_GAPPED_COLS)}' AS columns,
  '{','.join(t for _, t, _ in _GAPPED_TYPES)}' AS dtypes,
  concat_ws(',', {', '.join(f"({m})::VARCHAR" for m in _MISSING.values())}) AS missing_counts,
  '{','.join(c for c, _, k in _GAPPED_TYPES if k == "numeric")}' AS numeric_columns,
  '{','.join(c for c, _, k in _GAPPED_TYPES if k == "text")}' AS text_columns,
  '{','.join(c for c, _, k in _GAPPED_TYPES if k == "datetime")}' AS datetime_columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {GAPPED})) AS duplicates,
  {_r(f"100.0 * (count(*) * {len(_MISSING)} - ({' + '.join(f'({m})' for m in _MISSING.values())})) / (count(*) * {len(_MISSING)})", 2)} AS completeness,
  true AS dated
FROM {GAPPED}""")
def q_schema_json(spark, d):
    """The whole schema map, read back from the JSON sink."""
    doc = profile.schema_document(gapped_orders(spark, d), "orders")
    back = spark.read.schema(doc.schema).json(sources.write_json(doc, scratch_path(spark, "schema_json")))
    names = F.col("columns")
    return back.select("dataset_name", "rows", F.array_join(names, ",").alias("columns"),
                       F.array_join(F.transform(names, lambda c: F.col("dtypes")[c]), ",").alias("dtypes"),
                       F.array_join(F.transform(names, lambda c: F.col("missing_counts")[c].cast("string")), ",").alias("missing_counts"),
                       *[F.array_join(F.col("column_types")[k], ",").alias(f"{k}_columns") for k in ("numeric", "text", "datetime")],
                       "data_quality.duplicates", "data_quality.completeness", F.col("generated_at").isNotNull().alias("dated"))


# ---------------------------------------------------------------- the same operators on text, arrays, labels
@register("text_duplicates", f"""
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       {_r("100.0 * sum(n - 1) / sum(n)", 1)} AS duplicate_pct FROM g""")
def q_text_duplicates(spark, d):
    """Exact duplicate documents, compared on their whole text."""
    return profile.duplicates(load(spark, d, "documents").select("text"))


@register("documents_describe_text", _union_sql([_TEXT_SQL.format(c=c, t="documents")
                                                 for c in ("text", "lang", "source")]))
def q_documents_describe_text(spark, d):
    """count / unique / most frequent value (whole texts) / its frequency."""
    return profile.describe_text(load(spark, d, "documents"), ["text", "lang", "source"])


_NCH = "CAST(n_chars AS DECIMAL(38,0))"


@register("documents_length_outliers", f"""
WITH v AS (SELECT {_NCH} AS x FROM documents WHERE n_chars IS NOT NULL),
s AS (SELECT count(x) AS n, {_mean_sql('x')} AS m, {_std_sql('x')} AS sd FROM v),
z AS (SELECT CAST(x AS DOUBLE) AS value FROM v, s WHERE abs((CAST(x AS DOUBLE) - m) / sd) > 3),
a AS (SELECT count(*) AS c, min(value) AS mn, max(value) AS mx FROM z)
SELECT 'n_chars' AS column, 'zscore' AS method, n AS count, {_r('m', 3)} AS mean, {_r('sd', 3)} AS std,
       c AS outliers, {_r('100.0 * c / n', 2)} AS outlier_pct, {_r('mn', 3)} AS range_min,
       {_r('mx', 3)} AS range_max FROM s, a""")
def q_documents_length_outliers(spark, d):
    return outliers.zscore_outliers(load(spark, d, "documents"), "n_chars")


@register("embeddings_overview", """
SELECT 0 AS position, 'vec_id' AS column, 'bigint' AS dtype, 'numeric' AS type_class,
       count(vec_id) AS non_null, count(*) - count(vec_id) AS nulls FROM embeddings
UNION ALL SELECT 1, 'embedding', 'array<float>', 'other', count(embedding), count(*) - count(embedding) FROM embeddings
UNION ALL SELECT 2, 'label', 'int', 'numeric', count(label), count(*) - count(label) FROM embeddings""")
def q_embeddings_overview(spark, d):
    return profile.overview(load(spark, d, "embeddings"))


@register("embeddings_duplicates", f"""
WITH g AS (SELECT count(*) AS n FROM embeddings GROUP BY embedding, label)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       {_r("100.0 * sum(n - 1) / sum(n)", 1)} AS duplicate_pct FROM g""")
def q_embeddings_duplicates(spark, d):
    """Duplicate (vector, label) rows, vectors compared element by element."""
    return profile.duplicates(load(spark, d, "embeddings").select("embedding", "label"))


_LAB_EXACT = {"quality": "CAST(quality AS DECIMAL(38,0))", "toxic": "CAST(toxic AS DECIMAL(38,0))"}


@register("labels_correlation", _union_sql(
    [f"SELECT '{a}' AS col_x, '{b}' AS col_y, {i} AS ix, {j} AS iy, CAST("
     + (f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END" if i == j else
        _corr_sql_any(*sorted((a, b), key=["quality", "toxic"].index), _LAB_EXACT))
     + " AS DOUBLE) AS r FROM labels"
     for i, a in enumerate(["quality", "toxic"]) for j, b in enumerate(["quality", "toxic"])]))
def q_labels_correlation(spark, d):
    return stats.correlation_matrix(load(spark, d, "labels"), ["quality", "toxic"])


@register("conversations_group_mean", f"""
SELECT role, {_r(_mean_sql('CAST(turn AS DECIMAL(38,0))'), 6)} AS mean_turn
FROM conversations WHERE role IS NOT NULL GROUP BY role""")
def q_conversations_group_mean(spark, d):
    out = stats.group_stats(load(spark, d, "conversations"), "role", "turn", "mean")
    return out.select("role", F.round("mean", 6).alias("mean_turn"))


# ---------------------------------------------------------------- streaming overview of arriving files
@register("overview_stream", "SELECT * FROM (" + _union_sql([
    f"SELECT {i} AS position, '{c}' AS column, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM {GAPPED}"
    for i, (c, t, k) in enumerate(_GAPPED_TYPES)]) + ")")
def q_overview_stream(spark, d):
    """Gapped orders land as CSV files (four parts) in a scratch folder; the
    streaming overview keeps running present/missing counts over them."""
    from pyspark.sql import types as T
    import uuid
    from tablescope.streaming import start_overview
    folder = scratch_path(spark, "landing")
    g = gapped_orders(spark, d).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    landed = sources.write_table(g.repartition(4, "o_orderkey"), folder, "csv", null_value="NA")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                           T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderdate", T.StringType()), T.StructField("o_orderpriority", T.StringType())])
    name = f"overview_{uuid.uuid4().hex}"
    q = start_overview(spark, landed, schema, name, scratch_path(spark, "stream-state"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT position, column, non_null, nulls FROM {name}")


# ---------------------------------------------------------------- training-data operators, where they are present
try:
    from tablescope.llm import queries as _llm
    _QUERIES.update(_llm.QUERIES)
    _SQL.update(_llm.SQL)
    import corpus_pipeline as _pipeline
    _QUERIES["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL:
        _SQL["pipeline"] = _pipeline.ORACLE_SQL
except ImportError:  # they, or a library that only they need, are not there
    pass


# ---------------------------------------------------------------- driver API
def entry(spark: SparkSession) -> DataFrame:
    """Flagship: grouped sum of l_extendedprice by l_returnflag on sf0.001."""
    return q_group_sum(spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
