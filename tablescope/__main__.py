"""Command line: inspect, clean and analyse one delimited file.

    python -m tablescope data/records.csv --out outputs --value amount --group region --date registered_on

Writes, under ``--out``: the cleaned table (``cleaned_data.csv`` and a Parquet
copy), ``schema_map``, ``transformation_log``, and one JSON folder per finding
under ``findings/<step>/<name>``. Under spark-submit pass ``--master ""`` and
set ``spark.checkpoint.dir`` to shared storage.
"""

from __future__ import annotations

import argparse

from . import plans, sources
from .session import build_session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m tablescope", description=__doc__.split("\n\n")[0])
    p.add_argument("path", help="delimited text file or folder of files")
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--value", help="numeric column to analyse (default: first numeric)")
    p.add_argument("--group", help="category column (default: first text column)")
    p.add_argument("--date", help="date column for the trend analysis")
    p.add_argument("--freq", default="M", choices=["D", "M", "Q", "Y"])
    p.add_argument("--master", default="local[*]", help='Spark master; "" under spark-submit')
    p.add_argument("--partitions", type=int, default=8, help="spark.sql.shuffle.partitions")
    a = p.parse_args(argv)
    spark = build_session(a.master or None, a.partitions)
    out = a.out.rstrip("/")
    result = plans.run(spark, a.path, out, a.value, a.group, a.date, a.freq)
    for step, findings in result.items():
        for name in findings.names():
            sources.write_json(findings[name], f"{out}/findings/{step}/{name}")
            print(f"wrote {out}/findings/{step}/{name}")


if __name__ == "__main__":
    main()
