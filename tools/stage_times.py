"""Summarise a Spark event log: per job, wall time and the slowest stages.

usage: python tools/stage_times.py <event-log-file> [top]
"""

from __future__ import annotations

import json
import os
import sys


def _open(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        yield from open(path)


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    files = [path]
    if os.path.isdir(path):  # rolling event log folder (eventlog_v2_*)
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_"))
    stages = {}
    lines = (ln for f in files for ln in _open(f))
    for line in lines:
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            t0, t1 = info.get("Submission Time"), info.get("Completion Time")
            if t0 and t1:
                stages[info["Stage ID"]] = (t1 - t0, info["Stage Name"][:80], info["Number of Tasks"])
    rows = sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]
    print(f"{'stage':>6} {'ms':>8} {'tasks':>6}  name")
    for sid, (ms, name, n) in rows:
        print(f"{sid:>6} {ms:>8} {n:>6}  {name}")


if __name__ == "__main__":
    main()
