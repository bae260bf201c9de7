"""Stage and task timings of registered queries from Spark's event log (no UI involved).

``python tools/stage_times.py <sf_dir> <query> [query ...]`` runs each query through the
``noop`` sink with the event log written to a fresh scratch folder, then prints one JSON
line per stage: tasks, wall time, shuffle read/write bytes, and max/median task time
(a skew signal: near 1 means balanced tasks).
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_dir: str):
    """Event-log lines; Spark 4 writes rolling logs as folders of ``events_*`` files."""
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isfile(path) and not path.endswith(".inprogress"):
            with open(path) as fh:
                yield from fh


def stage_summary(log_dir: str) -> list[dict]:
    """One dict per completed stage: tasks, wall time, shuffle bytes, longest/median task time."""
    stages, tasks = {}, {}
    for line in _events(log_dir):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerTaskEnd":
            info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
            t = tasks.setdefault(ev["Stage ID"], [])
            t.append((info["Finish Time"] - info["Launch Time"],
                      metrics.get("Shuffle Read Metrics", {}).get("Remote Bytes Read", 0)
                      + metrics.get("Shuffle Read Metrics", {}).get("Local Bytes Read", 0),
                      metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)))
        elif kind == "SparkListenerStageCompleted":
            si = ev["Stage Info"]
            stages[si["Stage ID"]] = (si.get("Stage Name", ""), si.get("Completion Time", 0) - si.get("Submission Time", 0))
    out = []
    for sid, (name, wall) in sorted(stages.items()):
        durs = [d for d, _, _ in tasks.get(sid, [])] or [0]
        med = statistics.median(durs) or 1
        out.append({"stage": sid, "name": name.split(" at ")[0], "tasks": len(tasks.get(sid, [])), "wall_ms": wall,
                    "shuffle_read": sum(r for _, r, _ in tasks.get(sid, [])),
                    "shuffle_write": sum(w for _, _, w in tasks.get(sid, [])),
                    "max_over_median_task": round(max(durs) / med, 2)})
    return out


def main() -> None:
    from faultlens.plans.catalog import QUERIES, load_all
    from faultlens.session import build_session
    sf_dir, names = sys.argv[1], sys.argv[2:]
    log_dir = tempfile.mkdtemp(prefix="faultlens-eventlog-")
    spark = build_session(shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false"})
    load_all()
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    for row in stage_summary(log_dir):
        print(json.dumps(row))


if __name__ == "__main__":
    main()
