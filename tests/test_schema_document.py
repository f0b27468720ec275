"""Duplicate rows by narrow keys, and the whole schema map in one row, against plain Python."""

import json
from collections import Counter

import pytest

from tablescope import sources
from tablescope.operators import profile

SCHEMA = "n long, x double, t string, b binary, `a.b` string"
LONG = "long text " * 30
ROWS = [(1, 1.0, "a", b"z", LONG), (1, 1.0, "a", b"z", LONG), (1, 1.0, "a", b"z", LONG + " "), (None, None, None, None, None),
        (None, None, None, None, None), (2, float("nan"), LONG, LONG.encode(), ""), (2, float("nan"), LONG, LONG.encode(), ""),
        (2, None, LONG, LONG.encode(), ""), (3, 0.0, "x" * 64, b"", "y" * 65), (3, -0.0, "x" * 64, b"", "y" * 65), (3, 0.0, "x" * 65, None, "y" * 64)]


def key(row):
    return tuple("nan" if isinstance(v, float) and v != v else v for v in row)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_long_values_are_equal_where_their_texts_are(table):
    want = sum(n - 1 for n in Counter(map(key, ROWS)).values())
    assert profile.duplicates(table).first()[:2] == (len(ROWS), want)


def test_no_whole_text_is_shuffled(spark, table):
    plan = profile.duplicates(table.select("t"))._jdf.queryExecution().executedPlan().toString()
    exchange = next(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "_d0" in exchange and "_l0" in exchange


def test_schema_document_equals_plain_python(spark, table, tmp_path):
    doc = profile.schema_document(table, "rows")
    got = json.loads(spark.read.text(sources.write_json(doc, str(tmp_path / "map"))).first()[0])
    columns = ["n", "x", "t", "b", "a.b"]
    missing = {c: sum(r[i] is None or r[i] != r[i] for r in ROWS) for i, c in enumerate(columns)}
    assert got["columns"] == columns and got["rows"] == len(ROWS) and got["dataset_name"] == "rows" and got["generated_at"]
    assert got["missing_counts"] == missing and got["dtypes"] == dict(zip(columns, ["bigint", "double", "string", "binary", "string"]))
    assert got["column_types"]["numeric"] == ["n", "x"] and "a.b" in got["column_types"]["text"] and got["column_types"]["datetime"] == []
    cells = len(ROWS) * len(columns)
    assert got["data_quality"] == {"duplicates": sum(n - 1 for n in Counter(map(key, ROWS)).values()),
                                   "completeness": round(100 * (cells - sum(missing.values())) / cells, 2)}


def test_schema_document_of_no_rows(spark):
    r = profile.schema_document(spark.createDataFrame([], SCHEMA)).first()
    assert (r.rows, r.dataset_name, r.data_quality.duplicates, r.data_quality.completeness) == (0, None, 0, None)
    assert set(r.missing_counts.values()) == {0}
