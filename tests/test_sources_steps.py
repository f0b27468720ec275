"""Delimited reader dialects, sinks, audit log and declared steps."""

import os

import pytest

from tablescope import sources
from tablescope.operators import steps
from tests.conftest import rows


def _write(folder, name, data: bytes):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmpdir_path, sep):
    text = f"a{sep}b{sep}c\n1{sep}x{sep}1.5\n2{sep}y{sep}NA\n".encode()
    df = sources.read_delimited(spark, _write(tmpdir_path, "f.csv", text))
    assert df.columns == ["a", "b", "c"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double"]
    assert rows(df) == [(1, "x", 1.5), (2, "y", None)]


def test_latin1_header_spaces_and_quoted_newline(spark, tmpdir_path):
    data = b' name ;"multi\nline";city\nJos\xe9;"a\nb";Oslo\nAnn;c;nan\n'
    df = sources.read_delimited(spark, _write(tmpdir_path, "g.csv", data))
    assert df.columns == ["name", "multi line", "city"]
    assert rows(df) == [("José", "a\nb", "Oslo"), ("Ann", "c", None)]


def test_one_column_and_booleans(spark, tmpdir_path):
    df = sources.read_delimited(spark, _write(tmpdir_path, "h.csv", b"flag\nTrue\nfalse\n\n"))
    assert df.schema["flag"].dataType.simpleString() == "boolean"
    assert sorted(rows(df), key=str) == [(False,), (True,)]


def test_null_tokens_and_int_with_gap(spark, tmpdir_path):
    df = sources.read_delimited(spark, _write(tmpdir_path, "i.csv", b"k,v\n1,NULL\n2,N/A\n3,\n4,7\n"))
    assert df.schema["v"].dataType.simpleString() == "bigint"
    assert rows(df) == [(1, None), (2, None), (3, None), (4, 7)]


def test_write_roundtrip_and_count(spark, tmpdir_path):
    df = spark.createDataFrame([(" a ", 1.5), (None, 2.0)], "s string, x double")
    path = sources.write_table(df, os.path.join(tmpdir_path, "out"), "csv")
    assert path.endswith(".csv")
    back = sources.read_delimited(spark, path)
    assert sorted(rows(back), key=str) == sorted([(" a ", 1.5), (None, 2.0)], key=str)
    assert sources.count_written(spark, path).first()["rows"] == 2


def test_load_summary(spark):
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    got = rows(sources.load_summary(df), "column", "dtype", "type_class", "rows")
    assert got == [("k", "bigint", "numeric", 1), ("s", "string", "text", 1)]


def test_audit_log_appends(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "log")
    sources.append_log(spark, ["loaded", "cleaned"], path)
    sources.append_log(spark, ["analysed"], path)
    log = sources.read_log(spark, path)
    assert sorted(r["detail"] for r in log.collect()) == ["analysed", "cleaned", "loaded"]
    assert log.where("logged_at IS NULL").count() == 0


def test_apply_steps_with_audit(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "a", 4.0), (3, "a", 4.0)], "k int, g string, v double")
    out, audit = steps.apply_steps(df, [
        {"op": "dedupe"},
        {"op": "dropna", "subset": ["v"]},
        {"op": "derive", "name": "w", "expr": "v * 2"},
        {"op": "aggregate", "keys": ["g"], "exprs": {"total": "sum(w)"}},
    ])
    assert rows(out) == [("a", 12.0)]
    assert rows(audit, "operation", "rows_before", "rows_after") == [
        ("dedupe", 4, 3), ("dropna", 3, 2), ("derive", 2, 2), ("aggregate", 2, 1)]
    with pytest.raises(ValueError):
        steps.apply_steps(df, [{"op": "eval", "code": "x"}])


def test_filter_year_category_all_is_noop(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2023, 1, 1), "x"), (dt.date(2024, 1, 1), "y")], "d date, c string")
    assert steps.filter_year_category(df, "d").count() == 2
    assert steps.filter_year_category(df, "d", 2024, "c", "all").count() == 1
    assert steps.filter_year_category(df, "d", "all", "c", "x").count() == 1


def test_bad_byte_beyond_sniffed_head_is_found(spark, tmpdir_path):
    body = b"".join(b"row%d,%d\n" % (i, i) for i in range(50))
    data = b"name,v\n" + body + b"Jos\xe9,99\n"
    df = sources.read_delimited(spark, _write(tmpdir_path, "late.csv", data), sample_lines=5)
    assert df.where("v = 99").first()["name"] == "José"


def test_windows_line_endings(spark, tmpdir_path):
    df = sources.read_delimited(spark, _write(tmpdir_path, "crlf.csv", b"a;b\r\n1;x\r\n2;y\r\n"))
    assert df.columns == ["a", "b"]
    assert rows(df) == [(1, "x"), (2, "y")]


def test_csv_sink_writes_nested_values_as_json(spark, tmpdir_path):
    df = spark.createDataFrame([(1, [1.5, 2.0])], "k long, v array<double>")
    back = sources.read_delimited(spark, sources.write_table(df, os.path.join(tmpdir_path, "nested"), "csv"))
    assert rows(back) == [(1, "[1.5,2.0]")]


def test_every_declared_verb(spark):
    df = spark.createDataFrame([(1, "a", "2.5", None), (2, "b", "x", 4.0), (3, "a", "7", 1.0)],
                               "k int, g string, t string, v double")
    out, audit = steps.apply_steps(df, [
        {"op": "filter", "cond": "k >= 2 OR g = 'a'"},
        {"op": "cast", "col": "t", "type": "double"},
        {"op": "fillna", "values": {"v": 0.0, "t": -1.0}},
        {"op": "replace", "col": "g", "mapping": {"a": "A"}},
        {"op": "rename", "mapping": {"g": "grp"}},
        {"op": "derive", "name": "w", "expr": "v + t"},
        {"op": "drop", "cols": ["k"]},
        {"op": "select", "cols": ["grp", "w", "t"]},
        {"op": "sort", "cols": ["w"], "ascending": False},
        {"op": "limit", "n": 2},
    ])
    assert rows(out) == [("A", 8.0, 7.0), ("b", 3.0, -1.0)]
    counts = rows(audit, "operation", "rows_before", "rows_after")
    assert counts[0] == ("filter", 3, 3) and counts[-1] == ("limit", 3, 2)
    assert all(b == a for op, b, a in counts if op in steps.ROW_PRESERVING)


def test_count_written_reads_as_written(spark, tmp_path):
    from tablescope import sources
    df = spark.createDataFrame([("x,y\\",), ("a\nb",), ('q"r',), ("plain",)], "t string").coalesce(1)
    assert sources.count_written(spark, sources.write_table(df, str(tmp_path / "t"))).first().rows == 4


def test_year_filter_is_a_pushed_range(spark, tmp_path):
    from tablescope.operators import steps
    df = spark.sql("select date'2023-12-31' d union all select date'2024-01-01' union all select date'2024-12-31' union all select date'2025-01-01'")
    df.write.parquet(str(tmp_path / "d"))
    out = steps.filter_year_category(spark.read.parquet(str(tmp_path / "d")), "d", 2024)
    assert out.count() == 2
    assert "GreaterThanOrEqual(d,2024-01-01)" in out._jdf.queryExecution().toString()
    text = spark.createDataFrame([("2024-05-01",), ("nothing",)], "d string")
    assert steps.filter_year_category(text, "d", 2024).count() == 1


def test_logged_time_is_the_one_written(spark, tmp_path):
    from tablescope import sources
    log = sources.append_log(spark, ["a"], str(tmp_path / "log"))
    assert log.first().logged_at == sources.read_log(spark, str(tmp_path / "log")).first().logged_at


def test_nan_key_is_missing(spark):
    from tablescope.operators import stats
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 2), (None, 3)], "k double, v int")
    assert [r.k for r in stats.group_stats(df, "k", "v", "sum").collect()] == [1.0]


def test_quoted_newline_after_the_sampled_lines(spark, tmpdir_path):
    body = "".join(f"{i},t{i}\n" for i in range(1500)) + '1500,"two\nlines"\n1501,end\n'
    df = sources.read_delimited(spark, _write(tmpdir_path, "late.csv", ("id,s\n" + body).encode()))
    assert df.count() == 1502 and df.schema["id"].dataType.simpleString() == "bigint"
    assert df.where("id = 1500").first()["s"] == "two\nlines"


@pytest.mark.parametrize("infer", [True, False])
@pytest.mark.parametrize("last", ["3,4,5", "3,4,", '"3,3",4,,5'])
def test_extra_fields_raise(spark, tmpdir_path, last, infer):
    path = _write(tmpdir_path, "extra.csv", ("a,b\n" + "1,2\n" * 1200 + last + "\n").encode())
    with pytest.raises(ValueError, match="1 row.* more fields"):
        sources.read_delimited(spark, path, infer=infer)


def test_short_rows_end_in_nulls_and_quoted_separators_do_not_count(spark, tmpdir_path):
    df = sources.read_delimited(spark, _write(tmpdir_path, "short.csv", b'a;b;c\n1;x;2\n3;y\n4;"p;q";5\n'))
    assert rows(df) == [(1, "x", 2), (3, "y", None), (4, "p;q", 5)]


def test_csv_keeps_fractions_of_a_second(spark, tmpdir_path):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.123456' AS t UNION ALL SELECT timestamp'2024-01-02 00:00:00'")
    back = sources.read_delimited(spark, sources.write_table(df, os.path.join(tmpdir_path, "ts"), "csv"))
    assert sorted(rows(back)) == [("2024-01-02 00:00:00",), ("2024-01-02 03:04:05.123456",)]
