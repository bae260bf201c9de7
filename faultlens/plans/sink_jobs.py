"""Registered queries: sinks and file sources (SNK1-SNK5, SNK7, SRC8-SRC9) as write-then-read round trips."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators import logs as L
from faultlens.operators import detect as D
from faultlens.operators import runs as RO
from faultlens.plans import metric_jobs as MJ
from faultlens.plans import detect_jobs as DJ
from faultlens.plans import run_jobs as RJ
from faultlens.plans import mapreduce_jobs as MR
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte, register
from faultlens.plans.log_jobs import ALL_END, ALL_START, ALL_UNION_SQL, RAW
from faultlens.plans.collect import LOG_FILE_COLUMNS, write_logs
from faultlens.session import prepare, scratch_path
from faultlens.functions.logs import first_ipv4
from faultlens.functions.metrics import literal_map
from faultlens.plans import dims
from faultlens.sinks.files import (CSV_OPTIONS, read_json_lines, read_key_value_text, read_partitioned_csv, write_json_lines,
                                  write_key_value_text, write_partitioned_csv)
from faultlens.sources import fixtures as fx
from faultlens.sources.runfiles import read_csv_by_header

LOG_CSV_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("component", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()),
])
assert [f.name for f in LOG_CSV_SCHEMA.fields] == LOG_FILE_COLUMNS


@register("csv_roundtrip", oracle=cte(**RAW, store=S.STORE_SQL, parsed=S.PARSED_SQL) + ALL_UNION_SQL)
def csv_roundtrip(spark: SparkSession, sf_dir: str):
    """Collected logs written as per-node component / task CSV folders in the shared folder, read back."""
    prepare(spark)
    logs = L.union_logs(fx.raw_log(spark, sf_dir), ALL_START, ALL_END).drop("line_ts")
    path = scratch_path(spark, "csv_roundtrip")
    write_logs(logs, path)
    back = read_partitioned_csv(spark, path, LOG_CSV_SCHEMA, ["node", "log_file"])
    return back.select("event_id", "timestamp", "timestamp_ns", "component",
                       "node", "filename", "level", "task_id", "message", "source")


# --- metric sink (per host x metric folders) ---------------------------------------

METRIC_CSV_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_us", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("mountpoint", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


@register("metric_csv_roundtrip", oracle=cte(**MJ.MS) + MJ.FLAT_SQL)
def metric_csv_roundtrip(spark: SparkSession, sf_dir: str):
    """Flattened samples written as per-(hostname, metric) CSV folders, read back."""
    prepare(spark)
    flat = MJ._flat(spark, sf_dir)
    path = scratch_path(spark, "metric_csv")
    write_partitioned_csv(flat, path, ["hostname", "metric"], ["timestamp_us"], salt_source="timestamp_us")
    back = read_partitioned_csv(spark, path, METRIC_CSV_SCHEMA, ["hostname", "metric"])
    return back.select("timestamp", "timestamp_us", "metric", "category",
                       "hostname", "service", "device", "mode", "mountpoint",
                       F.round("value", 6).alias("value"))


# --- reclassified-log sink (per hostname x output name) ------------------------------

RECLASS_CSV_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("log_type", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
])


@register("reclass_csv_roundtrip", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + f"""
SELECT s.event_id, s.timestamp, s.timestamp_ns, r.log_type, r.hostname, s.level, s.message, r.out_name
FROM ({DJ.RECLASS_SQL}) r JOIN store s ON s.event_id = r.event_id""")
def reclass_csv_roundtrip(spark: SparkSession, sf_dir: str):
    """Records re-homed by the IP in their message, written per (hostname, output name), read back."""
    prepare(spark)
    rec = D.reclassify_by_ip(L.store_records(fx.raw_log(spark, sf_dir)))
    rows = rec.select("event_id", "timestamp", "timestamp_ns", "log_type", "hostname", "level", "message", "out_name")
    path = scratch_path(spark, "reclass_csv")
    write_partitioned_csv(rows, path, ["hostname", "out_name"], ["timestamp_ns", "event_id"], salt_source="event_id")
    back = read_partitioned_csv(spark, path, RECLASS_CSV_SCHEMA, ["hostname", "out_name"])
    return back.select("event_id", "timestamp", "timestamp_ns", "log_type", "hostname",
                       "level", "message", "out_name")


# --- run summary as JSON lines -----------------------------------------------------------

SUMMARY_SCHEMA = T.StructType([
    T.StructField("fault_type", T.StringType()),
    T.StructField("total_runs", T.LongType()),
    T.StructField("successful_runs", T.LongType()),
    T.StructField("failed_runs", T.LongType()),
    T.StructField("start_time", T.TimestampNTZType()),
])


@register("summary_json_roundtrip", oracle=cte(**RJ.BASE) + RJ.RESULTS_SQL)
def summary_json_roundtrip(spark: SparkSession, sf_dir: str):
    """Outcome totals written as JSON lines and read back with an explicit schema."""
    prepare(spark)
    path = scratch_path(spark, "summary_json")
    write_json_lines(RO.outcome_counts(RJ.landed_results(spark, sf_dir)), path)
    return read_json_lines(spark, path, SUMMARY_SCHEMA)


# --- job output as key<TAB>value text ----------------------------------------------------


@register("wordcount_text_roundtrip", oracle=MR.WORDCOUNT_SQL)
def wordcount_text_roundtrip(spark: SparkSession, sf_dir: str):
    """Word-count output replaced on write as ``word<TAB>n`` part files, read back."""
    prepare(spark)
    path = scratch_path(spark, "wordcount_text")
    write_key_value_text(MR.wordcount(spark, sf_dir), path, "word", "n")
    return read_key_value_text(spark, path, "word", "n")


# --- classified CSV trees of the user, by header name --------------------------------------


@register("classified_csv_scan", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + f"""
SELECT event_id, log_type, hostname, message, kind, ip FROM (
  SELECT event_id, CASE WHEN task_id IS NULL THEN component ELSE 'unknown' END AS log_type, message,
         CASE WHEN task_id IS NULL THEN 'component' ELSE 'task' END AS kind, ip,
         coalesce(CASE WHEN ip IS NULL THEN NULL ELSE coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in dims.IP_TO_HOST.items())}}}[ip], ip) END,
                  CASE WHEN task_id IS NULL THEN node ELSE 'unknown' END) AS hostname
  FROM (SELECT *, nullif(regexp_extract(message, '(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1), '') AS ip FROM store))""".replace("\\\\", "\\"))
def classified_csv_scan(spark: SparkSession, sf_dir: str):
    """CSV trees with different headers at different depths, read by header name (absent columns get their default), re-homed by IP."""
    prepare(spark)
    rec = L.store_records(fx.raw_log(spark, sf_dir))
    root = scratch_path(spark, "classified_csv")
    comp = rec.where("task_id is null").select("event_id", F.col("node").alias("hostname"), F.col("component").alias("log_type"), "level", "message")
    task = rec.where("task_id is not null").select("message", "timestamp", "event_id")
    for rows, folder in ((comp, "component"), (task, "deep/er/task")):
        rows.write.options(**CSV_OPTIONS).csv(f"{root}/{folder}")
    back = read_csv_by_header(spark, root, {"event_id": None, "hostname": "unknown", "log_type": "unknown", "message": ""})
    ip = first_ipv4(F.col("message"))
    host = F.coalesce(F.element_at(literal_map(dims.IP_TO_HOST), ip), ip, F.col("hostname"))
    kind = F.when(F.col("file").contains("/deep/er/task/"), F.lit("task")).otherwise(F.lit("component"))
    return back.select(F.col("event_id").cast("long").alias("event_id"), "log_type", host.alias("hostname"), "message", kind.alias("kind"), ip.alias("ip"))
