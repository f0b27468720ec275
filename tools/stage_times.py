"""Job and stage durations from a Spark event log (no UI, no server).

Usage: python tools/stage_times.py <event-log-dir-or-file> [top_n]
Prints the jobs, then the top_n slowest stages with task counts and names.
"""

from __future__ import annotations

import glob
import json
import os
import sys


def events(path):
    """Every event line below ``path`` (Spark 4 writes rolling logs: one folder per app)."""
    if os.path.isdir(path):
        files = sorted(f for f in glob.glob(os.path.join(path, "**", "*"), recursive=True) if os.path.isfile(f))
    else:
        files = [path]
    for f in files:
        name = os.path.basename(f)
        if name.startswith((".", "appstatus")) or name.endswith(".crc"):
            continue
        if name.endswith(".zstd"):
            import io
            import zstandard
            with open(f, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                for line in text:
                    yield json.loads(line)
        else:
            with open(f, encoding="utf-8") as fh:
                for line in fh:
                    yield json.loads(line)


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    jobs, stages = {}, {}
    for e in events(path):
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "stages": len(e.get("Stage Infos", []))}
        elif kind == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["ms"] = e["Completion Time"] - jobs[e["Job ID"]]["start"]
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            if "Submission Time" in info and "Completion Time" in info:
                stages[(info["Stage ID"], info["Stage Attempt ID"])] = (
                    info["Completion Time"] - info["Submission Time"], info["Number of Tasks"], info["Stage Name"])
    total = sum(j.get("ms", 0) for j in jobs.values())
    print(f"{len(jobs)} jobs, {sum(j.get('ms', 0) > 0 for j in jobs.values())} completed, {total / 1000:.1f} s in jobs; "
          f"{len(stages)} stages")
    for (sid, att), (ms, tasks, name) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"stage {sid}.{att}: {ms / 1000:.2f} s, {tasks} tasks, {name[:90]}")


if __name__ == "__main__":
    main()
