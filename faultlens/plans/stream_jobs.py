"""Registered queries: streaming log tagging, window counts, repeated rows, silence alarms and labelled rows (R4-R7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import logs as L
from faultlens.operators import runs as R
from faultlens.plans import run_jobs as RJ
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte, register
from faultlens.plans.log_jobs import RECORD_COLS
from faultlens.session import prepare, scratch_path
from faultlens.sources import fixtures as fx
from faultlens.sources.tables import read_table
from faultlens.streaming import logs as st
from faultlens.streaming import state

WINDOW, WATERMARK = "1 hour", "1 minute"


@register("stream_log_tag", oracle=cte(raw_log=fx.RAW_LOG_SQL, parsed=S.PARSED_SQL) + f"SELECT {RECORD_COLS} FROM parsed")
def stream_log_tag(spark: SparkSession, sf_dir: str):
    """File-stream source -> parse and tag each micro-batch -> parquet sink; result read back."""
    prepare(spark)
    base = scratch_path(spark, "stream_log_tag")
    tagged = st.tag_stream(st.stream_raw_log(spark, sf_dir)).drop("line_ts")
    st.run_available_now(tagged, base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out").select(*RECORD_COLS.split(", "))


@register("stream_log_counts", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, component, node, count(*) AS n
FROM (SELECT time_bucket(INTERVAL 1 HOUR, line_ts) AS window_start, component, node FROM store)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM raw_log) - INTERVAL 1 MINUTE
GROUP BY window_start, component, node""")
def stream_log_counts(spark: SparkSession, sf_dir: str):
    """Hourly log counts per (component, node) with a one-minute watermark (append mode: only
    windows closed by the watermark are emitted)."""
    prepare(spark)
    base = scratch_path(spark, "stream_log_counts")
    records = L.store_records(st.stream_raw_log(spark, sf_dir))
    counts = st.window_counts(records, "line_ts", ["component", "node"], WINDOW, WATERMARK)
    st.run_available_now(counts, base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")


def _arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files that land below a folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


@register("stream_dedup", oracle=cte(raw_log=fx.RAW_LOG_SQL, parsed=S.PARSED_SQL)
          + "SELECT DISTINCT filename, timestamp, timestamp_ns, level, message, node FROM parsed")
def stream_dedup(spark: SparkSession, sf_dir: str):
    """The log is collected twice, in two landings; the stream gives each record once."""
    prepare(spark)
    base = scratch_path(spark, "stream_dedup")
    for landing in ("first", "again"):
        read_table(spark, sf_dir, "events").write.parquet(f"{base}/land/{landing}")
    tagged = st.tag_stream(fx.raw_log_from(_arrivals(spark, base + "/land", st.EVENTS_SCHEMA)))
    once = state.first_collected(tagged, ["filename", "timestamp_ns", "message"], delay="40 days")
    st.run_available_now(once.select("filename", "timestamp", "timestamp_ns", "level", "message", "node"), base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")


SILENT_HOURS = 6


@register("stream_silence", oracle=f"""
WITH s AS (SELECT 'cpf-' || (user_id % 4 + 1) AS hostname, event_type AS mode, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY hostname, mode ORDER BY ts) < INTERVAL {SILENT_HOURS} HOUR THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY hostname, mode ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT hostname, mode, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM i GROUP BY hostname, mode, session
HAVING max(ts) + INTERVAL {SILENT_HOURS} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def stream_silence(spark: SparkSession, sf_dir: str):
    """Alarms of series that have been silent for six hours, given while samples still arrive."""
    prepare(spark)
    base = scratch_path(spark, "stream_silence")
    samples = fx.gauge_from(st.event_stream(spark, sf_dir))
    alarms = state.silence_alarms(samples, ["hostname", "mode"], "ts", f"{SILENT_HOURS} hours", WATERMARK)
    st.run_available_now(alarms, base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")


@register("stream_labelled", oracle=cte(**RJ.BASE, store=S.STORE_SQL, catalogue=RJ.CATALOGUE_SQL, info=RJ.FAULT_INFO_SQL) + """
SELECT i.run_id, i.fault_type, s.event_id, s.node, s.component, s.level
FROM info i JOIN store s ON list_contains(i.affected_nodes, s.node) AND s.line_ts >= i.window_start AND s.line_ts < i.window_end""")
def stream_labelled(spark: SparkSession, sf_dir: str):
    """Run windows arrive as one stream, logs as another: log rows of affected nodes inside the runs' windows."""
    prepare(spark)
    base = scratch_path(spark, "stream_labelled")
    windows = R.with_fault_info(RJ._windows(spark, sf_dir)).select(
        "run_id", "fault_type", "window_start", "window_end", F.explode(F.array_distinct("affected_nodes")).alias("node"))
    windows.write.parquet(base + "/windows")
    logs = L.store_records(st.stream_raw_log(spark, sf_dir))
    rows = state.windowed_rows(logs, _arrivals(spark, base + "/windows", windows.schema), ["node"])
    st.run_available_now(rows.select("run_id", "fault_type", "event_id", "node", "component", "level"), base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")
