"""Slowest stages from a Spark event log (v1 file or v2 rolling directory).

Usage: python tools/stage_times.py <event log dir or file> [top_n]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    found = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True))
    return found or sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p))


def _lines(f: str):
    if f.endswith(".zstd") or f.endswith(".zst"):
        import io

        import zstandard
        with open(f, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(f, encoding="utf-8") as fh:
            yield from fh


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = {}
    for f in _files(path):
        for line in _lines(f):
            if True:
                e = json.loads(line)
                if e.get("Event") == "SparkListenerStageCompleted":
                    si = e["Stage Info"]
                    dur = si.get("Completion Time", 0) - si.get("Submission Time", 0)
                    stages[si["Stage ID"]] = (dur, si["Number of Tasks"], si["Stage Name"][:70])
    for sid, (dur, n, name) in sorted(stages.items(), key=lambda x: -x[1][0])[:top]:
        print(f"stage {sid:5d}  {dur:7d} ms  {n:5d} tasks  {name}")


if __name__ == "__main__":
    main()
