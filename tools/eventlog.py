"""Summarise a Spark event log folder: per job (grouped by job group) and per stage times.

    python tools/eventlog.py <eventlog dir> [group ...]
"""

from __future__ import annotations

import glob
import io
import json
import sys

import zstandard


def events(folder: str):
    for f in sorted(glob.glob(f"{folder}/**/events_*", recursive=True)):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main():
    folder, groups = sys.argv[1], set(sys.argv[2:])
    stages, jobs = {}, {}
    for e in events(folder):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e.get("Properties", {}).get("spark.jobGroup.id"),
                                 e["Submission Time"], e["Stage IDs"], None]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][3] = e["Completion Time"] - jobs[e["Job ID"]][1]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Stage Name"].split(" at ")[0][:30], si["Number of Tasks"],
                                      si.get("Completion Time", 0) - si.get("Submission Time", 0))
    t0 = None
    for jid, (group, start, sids, ms) in sorted(jobs.items()):
        if groups and group not in groups:
            continue
        t0 = start if t0 is None else t0
        done = [(s, stages[s][1], stages[s][2]) for s in sids if s in stages]
        print(f"job {jid:4d} {group or '-':24s} +{start - t0:6d}ms {ms}ms stages(id,tasks,ms)={done}")


if __name__ == "__main__":
    main()
