"""Detection over collected data: stragglers, failure profile, silence gaps, IP reclassification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import logs as L
from faultlens.functions.metrics import literal_map
from faultlens.functions.time import epoch_micros
from faultlens.operators.ordering import exact_median, materialize, with_previous
from faultlens.plans import dims


def straggler_rank(task_lines: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Span of each (task, node) against the median span of all; ratio above ``threshold`` flags it.

    Spans are one aggregate row per (task, node), materialised once; the exact median is
    found from global positions (no single buffer of all spans) and read as one scalar."""
    spans = materialize(task_lines.groupBy("task_id", "node").agg(
        ((epoch_micros(F.max("line_ts")) - epoch_micros(F.min("line_ts"))) / F.lit(1e6)).alias("span_s")))
    # one number, evaluated once (it is used three times below)
    median_value = spans.sparkSession.range(1).select(exact_median(spans, "span_s", ["task_id", "node"])).first()[0]
    median = F.lit(median_value).cast("double")
    ratio = F.try_divide(F.col("span_s"), median)
    return spans.select("task_id", "node", F.round("span_s", 6).alias("span_s"), F.round(median, 6).alias("median_s"),
                        F.round(ratio, 6).alias("ratio"), (ratio > F.lit(threshold)).alias("straggler"))


def failure_profile(task_lines: DataFrame) -> DataFrame:
    """ERROR lines and their share per task."""
    return task_lines.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("level") == "ERROR").alias("error_lines")) \
        .withColumn("error_rate", F.round(F.try_divide(F.col("error_lines"), F.col("lines")), 6))


def silence_gaps(df: DataFrame, group_cols: list[str], ts_col: str, tiebreak: str, min_gap_seconds: int,
                 bucket_seconds: int = 86400) -> DataFrame:
    """Consecutive rows of a group at least ``min_gap_seconds`` apart: (group, gap_start, gap_end, gap_s)."""
    prev = with_previous(df.select(*group_cols, ts_col, tiebreak), group_cols, ts_col, tiebreak, [],
                         bucket_seconds=bucket_seconds)
    gap = (epoch_micros(ts_col) - epoch_micros("prev_" + ts_col)) / F.lit(1e6)
    return prev.where(gap >= min_gap_seconds).select(
        *group_cols, F.col("prev_" + ts_col).alias("gap_start"), F.col(ts_col).alias("gap_end"),
        F.round(gap, 6).alias("gap_s"))


def reclassify_by_ip(records: DataFrame, ip_hosts: dict | None = None,
                     static_types: list[str] | None = None) -> DataFrame:
    """Classified-log adapter (log_type = task id or component, hostname = node), then the
    host of the first IP in the message (unknown IP -> the IP itself, none -> row host) and
    the output name (static type -> itself, else ``task_<type>``)."""
    ip_hosts = ip_hosts or dims.IP_TO_HOST
    static_types = static_types or dims.STATIC_LOG_TYPES
    ip = L.first_ipv4(F.col("message"))
    host = F.when(F.col("message").isNull() | (F.col("message") == ""), F.lit(None)) \
        .otherwise(F.coalesce(F.element_at(literal_map(ip_hosts), ip), ip))
    log_type = F.coalesce(F.col("task_id"), F.col("component"))
    out = records.withColumns({"log_type": log_type, "original_hostname": F.coalesce(F.col("node"), F.lit("unknown"))})
    out = out.withColumns({"ip": ip, "hostname": F.coalesce(host, F.col("original_hostname"))})
    return out.withColumn("out_name", F.when(F.col("log_type").isin(static_types), F.col("log_type"))
                          .otherwise(F.concat(F.lit("task_"), F.col("log_type"))))


def reclass_rollup(reclassified: DataFrame) -> DataFrame:
    """Rows per (hostname, log_type), per hostname, and overall."""
    return reclassified.rollup("hostname", "log_type").agg(F.count(F.lit(1)).alias("n"))
