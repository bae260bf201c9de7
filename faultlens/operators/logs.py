"""Log ETL: tag paths, parse task-log lines, store records, union and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import logs as L
from faultlens.functions.time import epoch_nanos, from_epoch_micros, ts_text_ms, ts_text_s

RECORD_COLUMNS = ["timestamp", "timestamp_ns", "component", "node", "filename", "level", "task_id", "message"]


def tag_paths(df: DataFrame, path_col: str = "filename") -> DataFrame:
    """Adds component, node and task_id derived from the log path."""
    f = F.col(path_col)
    return df.withColumns({
        "component": L.component_from_filename(f),
        "node": L.node_from_filename(f),
        "task_id": L.task_id_from_filename(f),
    })


def parse_lines(raw: DataFrame, line_col: str = "line", keep=("event_id", "filename")) -> DataFrame:
    """Task-log lines -> records; lines without date, time and text, or with a bad time, are dropped.

    Output: keep columns, ``line_ts`` (TIMESTAMP_NTZ), timestamp (text, ms), timestamp_ns,
    level (from message text), message, plus the path tags.
    """
    keep = [c for c in keep if c in raw.columns]
    staged = raw.select(*keep, L.line_parts(F.col(line_col)).alias("_p"))
    line_ts = L.parse_line_time(F.get("_p", 0), F.get("_p", 1))
    # The validity test needs the parsed time.  A Filter on it would be pushed below the
    # projection with the whole parse inlined, running the parse twice; a generator over a
    # 0/1-element array evaluates it once per line.
    rec = F.struct((F.size("_p") == 3).alias("_ok"), line_ts.alias("line_ts"),
                   L.message_of(F.col("_p")).alias("message"))
    parsed = staged.select(*keep, F.inline(F.filter(F.array(rec), lambda r: r["_ok"] & r["line_ts"].isNotNull())))
    out = parsed.select(*keep, "line_ts", ts_text_ms("line_ts").alias("timestamp"),
                        epoch_nanos("line_ts").alias("timestamp_ns"),
                        L.level_from_message(F.col("message")).alias("level"), "message")
    return tag_paths(out) if "filename" in keep else out


def task_records(raw: DataFrame) -> DataFrame:
    """Task-log path (read whole, no time filter): ``application_`` files with a task id."""
    task_files = raw.where(F.col("filename").contains("application_")
                           & L.task_id_from_filename(F.col("filename")).isNotNull())
    return parse_lines(task_files)


def store_records(store: DataFrame, ts_col: str = "ts", line_col: str = "line") -> DataFrame:
    """Log-store rows (ingest time, path, line) -> component-style records.

    The store's level label is the first level word of the line (``unknown`` when blank).
    """
    out = store.select(
        *[c for c in ("event_id",) if c in store.columns],
        F.col(ts_col).alias("line_ts"),
        ts_text_s(ts_col).alias("timestamp"),
        epoch_nanos(ts_col).alias("timestamp_ns"),
        "filename",
        L.level_from_message(F.col(line_col)).alias("level"),
        F.col(line_col).alias("message"),
    )
    return tag_paths(out)


def time_range(df: DataFrame, start: str, end: str, ts_col: str = "ts") -> DataFrame:
    """Half-open time range ``[start, end)`` - a plain comparison, pushed to the parquet scan."""
    return df.where((F.col(ts_col) >= F.lit(start).cast("timestamp_ntz"))
                    & (F.col(ts_col) < F.lit(end).cast("timestamp_ntz")))


def component_records(store: DataFrame, start: str, end: str) -> DataFrame:
    """Component pass: in-range store rows of files without a task id (blank paths skipped)."""
    rec = store_records(time_range(store, start, end))
    return rec.where(F.col("task_id").isNull() & (F.col("component") != "unknown"))


def files_in_range(store: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct file names with any row in ``[start, end)``."""
    return time_range(store, start, end).select("filename").distinct()


def listed_task_files(store: DataFrame, start: str, end: str) -> DataFrame:
    """Task-file names with rows in range, materialised and broadcast only within the measured
    budget (a file list is small; beyond the budget the semi join shuffles)."""
    from faultlens.operators.ordering import materialize_sized, maybe_broadcast
    listed, seen = materialize_sized(
        files_in_range(store, start, end).where(F.col("filename").contains("application_")))
    return maybe_broadcast(listed, rows=seen["rows"], size=seen["bytes"])


def union_logs(store: DataFrame, start: str, end: str) -> DataFrame:
    """Component records in range plus whole task files listed in range, one schema."""
    comp = component_records(store, start, end).withColumn("source", F.lit("component"))
    task_raw = store.join(listed_task_files(store, start, end), "filename", "left_semi")
    task = task_records(task_raw).withColumn("source", F.lit("task"))
    cols = ["event_id", "line_ts", *RECORD_COLUMNS, "source"]
    return comp.select(*cols).unionByName(task.select(*cols), allowMissingColumns=True)


def task_time_span(task_lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per task (or other keys): first and last parsed line time and the line count (min/max are algebraic)."""
    return task_lines.groupBy(*(by or ["task_id"])).agg(
        F.min("line_ts").alias("first_ts"), F.max("line_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("lines"))


def flatten_log_responses(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """Log-store JSON pages -> component records.  A value whose time is not an integer is dropped."""
    from faultlens.sources.logstore import LOG_RESPONSE_SCHEMA
    doc = F.from_json(F.col(body_col), LOG_RESPONSE_SCHEMA)
    streams = responses.select(F.explode(doc["data"]["result"]).alias("s"))
    vals = streams.select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    rows = vals.select(
        F.element_at("labels", F.lit("filename")).alias("filename"),
        F.coalesce(F.element_at("labels", F.lit("level")), F.lit("unknown")).alias("level"),
        F.get("v", 0).try_cast("long").alias("timestamp_ns"),
        F.get("v", 1).alias("message"),
    ).where(F.col("timestamp_ns").isNotNull())
    ts = from_epoch_micros(F.expr("(timestamp_ns - pmod(timestamp_ns, 1000)) div 1000"))
    out = tag_paths(rows.withColumn("timestamp", ts_text_s(ts)))
    return (out.where(F.col("task_id").isNull() & (F.col("component") != "unknown"))
            .select("timestamp", "timestamp_ns", "component", "node", "filename", "level", "message"))
