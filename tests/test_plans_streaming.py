"""Composed inspect -> clean -> analyse run, and the streaming overview."""

import os

from pyspark.sql import types as T

from tablescope import plans, sources
from tablescope.streaming import start_overview


def test_run_end_to_end(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "records.csv")
    with open(src, "w") as f:
        f.write("Region Name ;RegisteredOn;Kind;Count\n")
        rows = ["North;2023-01-05;1;10", " North ;2023-02-07;2;NA", "South;2023-02-09;1;30", "South;2023-02-09;1;30",
                "South;05/03/2023;2;45", "East;2023-04-01;1;1000", "East;bad;2;12", "NA;2023-06-01;1;9"]
        f.write("\n".join(rows) + "\n")
    out = os.path.join(tmpdir_path, "out")
    res = plans.run(spark, src, out, value_col="Count", group_col="Region Name", date_col="RegisteredOn")
    assert res["inspection"]["duplicates"].first()["duplicate_rows"] == 1
    cleaned = sources.read_delimited(spark, os.path.join(out, "cleaned_data.csv"))
    assert cleaned.count() == 7 and cleaned.where("Count IS NULL").count() == 0
    assert sources.read_log(spark, os.path.join(out, "transformation_log")).count() >= 3
    a = res["analysis"]
    assert {"describe", "outliers", "trend_report", "box_by_group", "group_sum"} <= set(a.names())
    assert a["trend_report"].where("section = 'quality'").count() == 4


def test_streaming_overview(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "landing")
    os.makedirs(folder)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write("k,v\n1,x\n2,NA\n,y\n")
    q = start_overview(spark, folder, schema, "overview_test", os.path.join(tmpdir_path, "ckpt"))
    try:
        q.processAllAvailable()
        with open(os.path.join(folder, "b.csv"), "w") as f:
            f.write("k,v\n3,z\n")
        q.processAllAvailable()
        got = {r["column"]: (r["non_null"], r["nulls"]) for r in spark.sql("SELECT * FROM overview_test").collect()}
        assert got == {"k": (3, 1), "v": (3, 1)}
    finally:
        q.stop()


def test_command_line(spark, tmpdir_path):
    from tablescope.__main__ import main
    src = os.path.join(tmpdir_path, "in.csv")
    with open(src, "w") as f:
        f.write("g,v\na,1\nb,2\na,NA\nb,2\n")
    out = os.path.join(tmpdir_path, "out")
    main([src, "--out", out, "--value", "v", "--group", "g"])
    got = spark.read.json(os.path.join(out, "findings", "analysis", "group_sum"))
    # analysed after cleaning: the duplicate "b,2" is dropped, the gap in "a" gets the median 1.5
    assert {r["g"]: r["sum"] for r in got.collect()} == {"a": 2.5, "b": 2.0}
