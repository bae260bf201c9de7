"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is executed in full through the ``noop`` sink (no collect to the driver):
one warm run, then the median of ``$BENCH_REPS`` timed runs.  The tables that the queries read
are first laid out in one file per core (not timed): a table of one row group is one task, whatever
the engine does.  Streams read the original files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "wordcount", "skew_sum", "skew_sum_salted", "bloat_check", "identity_shuffle",
    "log_parse_lines", "log_stream_flatten", "log_topn_per_file", "log_sorted_rank", "log_union",
    "task_window_logs", "metric_flatten", "metric_instant", "metric_rate",
    "labelled_records", "collection_summary", "silence_gaps", "reclass_rollup", "fault_plan",
    "csv_roundtrip", "log_file_scan", "straggler_rank", "stream_log_tag", "stream_log_counts",
]
TABLES = ["events", "documents"]


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each, in the session's shared folder."""
    from faultlens.session import scratch_path
    to = scratch_path(spark, "bench_tables")
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(files).write.parquet(f"{to}/{table}.parquet")
    return to


def main() -> None:
    from faultlens.plans.catalog import QUERIES, load_all
    from faultlens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = build_session(shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    split_dir = laid_out(spark, sf_dir, spark.sparkContext.defaultParallelism)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir if name.startswith("stream_") else split_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        try:
            run()  # warm
            times[name] = round(statistics.median(run() for _ in range(reps)), 3)
            print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
        except Exception as exc:  # one broken query must not lose the whole measurement
            failed[name] = repr(exc)[:300]
            print(f"{name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    line = {"metric": "sum_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
            "queries": times, "sf": sf}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
