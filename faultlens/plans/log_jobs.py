"""Registered queries: log ETL (SRC2-SRC5, P4-P9, P11, F1-F3, W1, W3, U1, A3, A5, A6, J5)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultlens.operators import logs as ops
from faultlens.operators.ordering import running_rank, top_n_per_group
from faultlens.operators.rangejoin import range_join
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte, register
from faultlens.session import prepare
from faultlens.sources import fixtures as fx
from faultlens.sources.logstore import BAD_TIME_EVERY, UNLABELLED_PATH, log_responses

# Collection window used by the registered queries (inside the data's month).
RANGE_START, RANGE_END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
# The whole month, for counts over everything collected.
ALL_START, ALL_END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
TOP_N_PER_FILE = 50
TASK_MINUTES_BEFORE, TASK_MINUTES_AFTER = 3, 3

RAW = dict(raw_log=fx.RAW_LOG_SQL)
RECORD_COLS = "event_id, timestamp, timestamp_ns, component, node, filename, level, task_id, message"


@register("log_tag", oracle=cte(**RAW) + f"SELECT event_id, filename, {S.tags()} FROM raw_log")
def log_tag(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.tag_paths(fx.raw_log(spark, sf_dir)).select("event_id", "filename", "component", "node", "task_id")


@register("log_parse_lines", oracle=cte(**RAW, parsed=S.PARSED_SQL) + f"SELECT {RECORD_COLS} FROM parsed")
def log_parse_lines(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.parse_lines(fx.raw_log(spark, sf_dir)).select(*RECORD_COLS.split(", "))


@register("log_level", oracle=cte(**RAW, parsed=S.PARSED_SQL)
          + "SELECT component, level, task_id, count(*) AS n FROM parsed GROUP BY component, level, task_id")
def log_level(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return (ops.parse_lines(fx.raw_log(spark, sf_dir))
            .groupBy("component", "level", "task_id").agg(F.count(F.lit(1)).alias("n")))


IN_RANGE = f"line_ts >= TIMESTAMP '{RANGE_START}' AND line_ts < TIMESTAMP '{RANGE_END}'"


@register("log_time_filter", oracle=cte(**RAW, store=S.STORE_SQL) + f"SELECT {RECORD_COLS} FROM store WHERE {IN_RANGE}")
def log_time_filter(spark: SparkSession, sf_dir: str):
    prepare(spark)
    rows = ops.time_range(fx.raw_log(spark, sf_dir), RANGE_START, RANGE_END)
    return ops.store_records(rows).select(*RECORD_COLS.split(", "))


@register("log_filenames", oracle=cte(**RAW) + f"SELECT DISTINCT filename FROM raw_log WHERE "
          f"ts >= TIMESTAMP '{RANGE_START}' AND ts < TIMESTAMP '{RANGE_END}'")
def log_filenames(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.files_in_range(fx.raw_log(spark, sf_dir), RANGE_START, RANGE_END)


@register("log_stream_flatten", oracle=cte(**RAW, store=S.STORE_SQL) + f"""
SELECT timestamp, timestamp_ns, component, node, filename,
       CASE WHEN filename = '{UNLABELLED_PATH}' THEN 'unknown' ELSE level END AS level, message
FROM store WHERE task_id IS NULL AND component <> 'unknown' AND event_id % {BAD_TIME_EVERY} <> 0""")
def log_stream_flatten(spark: SparkSession, sf_dir: str):
    """Pages of the log-store API built from the landed rows, then flattened back to records."""
    prepare(spark)
    return ops.flatten_log_responses(log_responses(fx.raw_log(spark, sf_dir)))


@register("log_topn_per_file", oracle=cte(**RAW, store=S.STORE_SQL) + f"""
SELECT event_id, filename, timestamp_ns, rank FROM (
  SELECT event_id, filename, timestamp_ns,
         CAST(row_number() OVER (PARTITION BY filename ORDER BY line_ts, event_id) AS INTEGER) AS rank FROM store)
WHERE rank <= {TOP_N_PER_FILE}""")
def log_topn_per_file(spark: SparkSession, sf_dir: str):
    """Per-file cap (oldest first): the limit is the operator itself."""
    prepare(spark)
    rec = ops.store_records(fx.raw_log(spark, sf_dir))
    return top_n_per_group(rec, ["filename"], "line_ts", "event_id", TOP_N_PER_FILE) \
        .select("event_id", "filename", "timestamp_ns", "rank")


@register("log_sorted_rank", oracle=cte(**RAW, parsed=S.PARSED_SQL) + """
SELECT event_id, component, node, timestamp_ns,
       row_number() OVER (PARTITION BY component, node ORDER BY line_ts, event_id) AS rank FROM parsed""")
def log_sorted_rank(spark: SparkSession, sf_dir: str):
    prepare(spark)
    parsed = ops.parse_lines(fx.raw_log(spark, sf_dir))
    return running_rank(parsed, ["component", "node"], "line_ts", "event_id") \
        .select("event_id", "component", "node", "timestamp_ns", "rank")


def union_sql(start: str, end: str) -> str:
    """Component records in range plus the whole task files listed in range."""
    return f"""
SELECT {RECORD_COLS}, 'component' AS source FROM store
WHERE line_ts >= TIMESTAMP '{start}' AND line_ts < TIMESTAMP '{end}' AND task_id IS NULL AND component <> 'unknown'
UNION ALL
SELECT {RECORD_COLS}, 'task' AS source FROM parsed
WHERE contains(filename, 'application_') AND task_id IS NOT NULL
  AND filename IN (SELECT filename FROM raw_log WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}')
"""


UNION_SQL = union_sql(RANGE_START, RANGE_END)
ALL_UNION_SQL = union_sql(ALL_START, ALL_END)


@register("log_union", oracle=cte(**RAW, store=S.STORE_SQL, parsed=S.PARSED_SQL) + UNION_SQL)
def log_union(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.union_logs(fx.raw_log(spark, sf_dir), RANGE_START, RANGE_END).drop("line_ts")


@register("component_counts", oracle=cte(**RAW, store=S.STORE_SQL, parsed=S.PARSED_SQL, u=ALL_UNION_SQL)
          + "SELECT component, node, count(*) AS n FROM u WHERE source = 'component' GROUP BY component, node")
def component_counts(spark: SparkSession, sf_dir: str):
    prepare(spark)
    u = ops.union_logs(fx.raw_log(spark, sf_dir), ALL_START, ALL_END)
    return u.where(F.col("source") == "component").groupBy("component", "node").agg(F.count(F.lit(1)).alias("n"))


@register("task_counts", oracle=cte(**RAW, store=S.STORE_SQL, parsed=S.PARSED_SQL, u=ALL_UNION_SQL)
          + "SELECT task_id, node, count(*) AS n FROM u WHERE source = 'task' GROUP BY task_id, node")
def task_counts(spark: SparkSession, sf_dir: str):
    prepare(spark)
    u = ops.union_logs(fx.raw_log(spark, sf_dir), ALL_START, ALL_END)
    return u.where(F.col("source") == "task").groupBy("task_id", "node").agg(F.count(F.lit(1)).alias("n"))


TASK_LINES_SQL = "SELECT * FROM parsed WHERE contains(filename, 'application_') AND task_id IS NOT NULL"
RUN_SPAN_SQL = ("SELECT task_id, date_trunc('hour', line_ts) AS hour, min(line_ts) AS first_ts, max(line_ts) AS last_ts FROM task_lines "
                "GROUP BY task_id, date_trunc('hour', line_ts)")
SPAN_SQL = "SELECT task_id, min(line_ts) AS first_ts, max(line_ts) AS last_ts, count(*) AS lines FROM task_lines GROUP BY task_id"


@register("task_time_span", oracle=cte(**RAW, parsed=S.PARSED_SQL, task_lines=TASK_LINES_SQL) + SPAN_SQL)
def task_time_span(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.task_time_span(ops.task_records(fx.raw_log(spark, sf_dir)))


@register("task_window_logs", oracle=cte(**RAW, parsed=S.PARSED_SQL, store=S.STORE_SQL, task_lines=TASK_LINES_SQL,
                                         spans=RUN_SPAN_SQL) + f"""
SELECT w.task_id, w.hour, s.event_id, s.filename, s.component, s.node, s.timestamp_ns
FROM (SELECT task_id, hour,
             date_trunc('second', first_ts - INTERVAL {TASK_MINUTES_BEFORE} MINUTE) AS window_start,
             date_trunc('second', last_ts + INTERVAL {TASK_MINUTES_AFTER} MINUTE) AS window_end FROM spans) w
JOIN store s ON s.line_ts >= w.window_start AND s.line_ts < w.window_end
WHERE s.task_id IS NULL AND s.component <> 'unknown'""")
def task_window_logs(spark: SparkSession, sf_dir: str):
    """Component logs inside the time span of each task's activity of an hour, widened by minutes (range join J5)."""
    prepare(spark)
    raw = fx.raw_log(spark, sf_dir)
    spans = ops.task_time_span(ops.task_records(raw).withColumn("hour", F.date_trunc("hour", "line_ts").cast("timestamp_ntz")), ["task_id", "hour"])
    windows = spans.select(
        "task_id", "hour",
        F.date_trunc("second", F.col("first_ts") - F.expr(f"INTERVAL {TASK_MINUTES_BEFORE} MINUTES"))
        .cast("timestamp_ntz").alias("window_start"),
        F.date_trunc("second", F.col("last_ts") + F.expr(f"INTERVAL {TASK_MINUTES_AFTER} MINUTES"))
        .cast("timestamp_ntz").alias("window_end"))
    comp = ops.store_records(raw).where(F.col("task_id").isNull() & (F.col("component") != "unknown")) \
        .select("event_id", "filename", "component", "node", "timestamp_ns", "line_ts")
    return range_join(comp, windows, "line_ts").select(
        "task_id", "hour", "event_id", "filename", "component", "node", "timestamp_ns")


COLLECT_LIMIT = 60   # per file: cuts the busy files of the test tables

CAPPED_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY filename ORDER BY line_ts, event_id) AS rn FROM store
WHERE {IN_RANGE} AND task_id IS NULL AND component <> 'unknown'"""


@register("collect_logs", oracle=cte(**RAW, store=S.STORE_SQL, parsed=S.PARSED_SQL, capped=CAPPED_SQL) + f"""
SELECT {RECORD_COLS}, 'component' AS source FROM capped WHERE rn <= {COLLECT_LIMIT}
UNION ALL
SELECT {RECORD_COLS}, 'task' AS source FROM parsed
WHERE contains(filename, 'application_') AND task_id IS NOT NULL
  AND filename IN (SELECT filename FROM raw_log WHERE ts >= TIMESTAMP '{RANGE_START}' AND ts < TIMESTAMP '{RANGE_END}')""")
def collect_logs(spark: SparkSession, sf_dir: str):
    """Time-range log collection: component logs capped per file plus whole task files."""
    from faultlens.plans.collect import collect_logs as collect
    prepare(spark)
    return collect(fx.raw_log(spark, sf_dir), RANGE_START, RANGE_END, COLLECT_LIMIT).drop("line_ts")


@register("collect_logs_dropped", oracle=cte(**RAW, store=S.STORE_SQL, capped=CAPPED_SQL)
          + f"SELECT filename, count(*) AS dropped FROM capped WHERE rn > {COLLECT_LIMIT} GROUP BY filename")
def collect_logs_dropped(spark: SparkSession, sf_dir: str):
    """Rows that the collection's per-file cap leaves out, for each file that it cuts."""
    from faultlens.plans.collect import dropped_rows
    prepare(spark)
    return dropped_rows(fx.raw_log(spark, sf_dir), RANGE_START, RANGE_END, COLLECT_LIMIT)


COLLECT_TASK = "1700000000000_1005"


@register("collect_task_logs", oracle=cte(**RAW, store=S.STORE_SQL, parsed=S.PARSED_SQL) + f"""
, files AS (SELECT * FROM parsed WHERE contains(filename, '{COLLECT_TASK}') AND contains(filename, 'application_') AND task_id IS NOT NULL),
span AS (SELECT date_trunc('second', min(line_ts) - INTERVAL {TASK_MINUTES_BEFORE} MINUTE) AS a,
                date_trunc('second', max(line_ts) + INTERVAL {TASK_MINUTES_AFTER} MINUTE) AS b FROM files)
SELECT {RECORD_COLS}, 'component' AS source FROM store, span
WHERE line_ts >= a AND line_ts < b AND task_id IS NULL AND component <> 'unknown'
UNION ALL
SELECT {RECORD_COLS}, 'task' AS source FROM files""")
def collect_task_logs(spark: SparkSession, sf_dir: str):
    """Task-driven collection (F3): files whose path holds the task id set the window of the component logs."""
    from faultlens.plans.collect import collect_task_logs as collect
    prepare(spark)
    return collect(fx.raw_log(spark, sf_dir), COLLECT_TASK, TASK_MINUTES_BEFORE, TASK_MINUTES_AFTER)


@register("log_file_scan", oracle=cte(**RAW, parsed=S.PARSED_SQL)
          + "SELECT timestamp, timestamp_ns, component, node, filename, level, task_id, message FROM parsed")
def log_file_scan(spark: SparkSession, sf_dir: str):
    """Raw lines landed as text files per original path, scanned back as files, parsed and tagged."""
    from faultlens.session import scratch_path
    from faultlens.sources.files import read_log_tree, write_log_tree
    prepare(spark)
    root = write_log_tree(fx.raw_log(spark, sf_dir), scratch_path(spark, "log_files"), key_col="event_id")
    return ops.parse_lines(read_log_tree(spark, root), keep=("filename",)) \
        .select("timestamp", "timestamp_ns", "component", "node", "filename", "level", "task_id", "message")
