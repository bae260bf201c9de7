"""End-to-end collection, as a Spark user calls it: the reference's entry points as DataFrame jobs.

* :func:`collect_logs` - time-range collection: component logs in ``[start, end)`` capped per
  file (oldest first) plus every task file listed in the range, read whole.
* :func:`collect_task_logs` - task-driven collection: the task's own files fix the window
  (first/last line widened by minutes), component logs in that window plus the task files.
* :func:`collect_recent` - the quick mode: the last N minutes before an anchor.
* :func:`collect_metrics` - range-query pages flattened, pruned to the requested categories.
* :func:`write_dataset` - the per-node folder layout (CSV, salted writers) under one root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.operators import logs as L
from faultlens.operators import metrics as M
from faultlens.operators.ordering import top_n_per_group
from faultlens.operators.rangejoin import range_join
from faultlens.plans import dims
from faultlens.sinks.files import write_partitioned_csv

OUT_COLUMNS = ["event_id", *L.RECORD_COLUMNS, "source"]


def _capped(records: DataFrame, per_file_limit: int | None) -> DataFrame:
    if per_file_limit is None:
        return records
    return top_n_per_group(records, ["filename"], "line_ts", "event_id", per_file_limit).drop("rank")


def dropped_rows(store: DataFrame, start: str, end: str, per_file_limit: int) -> DataFrame:
    """``filename, dropped``: the component rows that a per-file limit leaves out, for each file that it cuts."""
    counts = L.component_records(store, start, end).groupBy("filename").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > per_file_limit).select("filename", (F.col("_n") - per_file_limit).alias("dropped"))


def collect_logs(store: DataFrame, start: str, end: str, per_file_limit: int | None = None,
                 task_source: str = "files") -> DataFrame:
    """Everything in range by default; with ``per_file_limit`` the oldest rows of each file, and
    :func:`dropped_rows` tells what the limit leaves out.

    ``task_source="files"``: task files listed in range are read whole and their lines parsed
    (level from the text).  ``"store"``: task logs come from the store like daemon logs - in
    range, capped per file, level from the store label (the batch runner's variant)."""
    comp = L.component_records(store, start, end)
    capped = _capped(comp, per_file_limit)
    if task_source == "store":
        in_range = L.store_records(L.time_range(store, start, end)).where(F.col("task_id").isNotNull())
        task = _capped(in_range, per_file_limit)
    else:
        task = L.task_records(store.join(L.listed_task_files(store, start, end), "filename", "left_semi"))
    return (capped.withColumn("source", F.lit("component")).select(*OUT_COLUMNS)
            .unionByName(task.withColumn("source", F.lit("task")).select(*OUT_COLUMNS)))


def collect_task_logs(store: DataFrame, task_id: str, minutes_before: int = 3, minutes_after: int = 3) -> DataFrame:
    """Files whose path contains the task id (and ``application_``) set the window; an empty
    result when the task has no parsable line."""
    files = store.where(F.col("filename").contains(task_id) & F.col("filename").contains("application_"))
    task = L.task_records(files)
    span = L.task_time_span(task.withColumn("task_id", F.lit(task_id)))
    window = span.select(
        F.date_trunc("second", F.timestamp_add("MINUTE", F.lit(-minutes_before), "first_ts"))
        .cast("timestamp_ntz").alias("window_start"),
        F.date_trunc("second", F.timestamp_add("MINUTE", F.lit(minutes_after), "last_ts"))
        .cast("timestamp_ntz").alias("window_end"))
    comp = L.store_records(store).where(F.col("task_id").isNull() & (F.col("component") != "unknown"))
    comp = range_join(comp, window, "line_ts").drop("window_start", "window_end")
    return (comp.withColumn("source", F.lit("component")).select(*OUT_COLUMNS)
            .unionByName(task.withColumn("source", F.lit("task")).select(*OUT_COLUMNS)))


def collect_recent(store: DataFrame, minutes: int, anchor: str | None = None,
                   per_file_limit: int | None = None) -> DataFrame:
    """Quick collection of the last ``minutes`` before ``anchor`` (default: the newest stored row).

    The anchor is one scalar read on the driver so that the range stays a literal
    comparison and is pushed into the scan."""
    import datetime as dt
    if anchor is None:
        newest = store.agg(F.max("ts")).first()[0]
        end = newest + dt.timedelta(microseconds=1)
    else:
        end = dt.datetime.fromisoformat(anchor)
    start = end - dt.timedelta(minutes=minutes)
    fmt = "%Y-%m-%d %H:%M:%S.%f"
    return collect_logs(store, start.strftime(fmt), end.strftime(fmt), per_file_limit)


def collect_metrics(responses: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Flattened samples of the requested categories (default cpu and memory)."""
    categories = categories or dims.DEFAULT_METRIC_CATEGORIES
    return M.flatten_metric_responses(responses).where(F.col("category").isin(categories))


def collect_runs(store: DataFrame, runs: DataFrame, per_file_limit: int | None = None) -> DataFrame:
    """What is collected for each run ``runs(run_id, window_start, window_end, ...)``, with the run's columns.

    Component rows in the run's window (the oldest ``per_file_limit`` of each file and run, if given), and every task file
    with a row in the window, read whole, with the level from its text.
    """
    carried = [c for c in runs.columns if c not in ("window_start", "window_end")]
    comp = L.store_records(store).where(F.col("task_id").isNull() & (F.col("component") != "unknown"))
    comp = range_join(comp, runs, "line_ts").drop("window_start", "window_end")
    if per_file_limit is not None:
        comp = top_n_per_group(comp, ["run_id", "filename"], "line_ts", "event_id", per_file_limit).drop("rank")
    named = store.select("filename", "ts").where(F.col("filename").contains("application_"))
    listed = range_join(named, runs, "ts").select("filename", *carried).distinct()
    task = L.task_records(store).join(listed, "filename")
    columns = [*OUT_COLUMNS, *carried]
    return (comp.withColumn("source", F.lit("component")).select(*columns)
            .unionByName(task.withColumn("source", F.lit("task")).select(*columns)))


def count_runs(store: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, name, node, rows)``: how many rows :func:`collect_runs` gives for each run's file on a node.

    Task files are counted once, whatever the number of runs that list them; their counts are joined to the listing.
    """
    comp = L.store_records(store).where(F.col("task_id").isNull() & (F.col("component") != "unknown")).select("line_ts", "component", "node")
    in_window = range_join(comp, runs, "line_ts").groupBy("run_id", F.col("component").alias("name"), "node").agg(F.count(F.lit(1)).alias("rows"))
    per_file = L.task_records(store).groupBy("filename", log_file_key().alias("name"), "node").agg(F.count(F.lit(1)).alias("rows"))
    named = store.select("filename", "ts").where(F.col("filename").contains("application_"))
    listed = range_join(named, runs, "ts").select("filename", "run_id").distinct()
    of_tasks = listed.join(per_file, "filename").groupBy("run_id", "name", "node").agg(F.sum("rows").alias("rows"))
    return in_window.unionByName(of_tasks)


def log_file_key(task_col: str = "task_id", component_col: str = "component"):
    """Per-node file key: ``<component>`` for daemon logs, ``task_<id>`` for task logs."""
    return F.coalesce(F.concat(F.lit("task_"), F.col(task_col)), F.col(component_col))


LOG_FILE_COLUMNS = ["event_id", "timestamp", "timestamp_ns", "component", "filename", "level", "task_id", "message",
                    "source"]


def write_logs(logs: DataFrame, path: str) -> str:
    """``<path>/node=<n>/log_file=<component | task_<id>>/*.csv``, each file sorted by time; the
    file columns are :data:`LOG_FILE_COLUMNS` in that order (CSV readers map by position)."""
    keyed = logs.select(*LOG_FILE_COLUMNS, "node", log_file_key().alias("log_file"))
    return write_partitioned_csv(keyed, path, ["node", "log_file"], ["timestamp_ns", "event_id"],
                                 salt_source="event_id")


def write_dataset(logs: DataFrame, metrics: DataFrame | None, root: str) -> str:
    """``<root>/logs/node=<n>/log_file=<f>/*.csv`` and ``<root>/metrics/hostname=<h>/metric=<m>/*.csv``."""
    write_logs(logs, f"{root}/logs")
    if metrics is not None:
        write_partitioned_csv(metrics, f"{root}/metrics", ["hostname", "metric"], ["timestamp_unix"],
                              salt_source="timestamp_unix")
    return root



def summary_report(summary: DataFrame) -> DataFrame:
    """Human-readable collection report per run (one multi-line text value per run), from the
    rows of the ``collection_summary`` query: fault, window, and collected files and rows."""
    def line(label: str, col: str):
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(col).cast("string"), F.lit("-")))
    text = F.concat_ws("\n",
                       line("run", "run_id"), line("fault type", "fault_type"), line("description", "description"),
                       line("job id", "job_id"), line("affected nodes", "affected_nodes"),
                       line("affected services", "affected_services"), line("injection method", "injection_method"),
                       F.concat(F.lit("window: "), F.col("window_start").cast("string"), F.lit(" - "),
                                F.col("window_end").cast("string")),
                       line("log files", "log_files"), line("log rows", "log_rows"),
                       line("metric series", "metric_series"), line("metric rows", "metric_rows"))
    return summary.select("run_id", text.alias("value"))


def write_summary_report(summary: DataFrame, root: str) -> str:
    """``<root>/run_id=<id>/part-*.txt``: each run's report in its own folder."""
    summary_report(summary).write.mode("overwrite").partitionBy("run_id").text(root)
    return root
