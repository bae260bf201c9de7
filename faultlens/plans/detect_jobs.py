"""Registered queries: detection and reclassification (R1-R4, P17, P19, J1, A8)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from faultlens.operators import detect as ops
from faultlens.operators import logs as L
from faultlens.plans import dims
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte, register
from faultlens.session import prepare
from faultlens.sources import fixtures as fx

TASK_LINES_SQL = "SELECT * FROM parsed WHERE contains(filename, 'application_') AND task_id IS NOT NULL"
TL = dict(raw_log=fx.RAW_LOG_SQL, parsed=S.PARSED_SQL, task_lines=TASK_LINES_SQL)
GAP_SECONDS = 6 * 3600


@register("straggler_rank", oracle=cte(**TL, spans="""
SELECT task_id, node, (epoch_us(max(line_ts)) - epoch_us(min(line_ts))) / 1e6 AS span_s
FROM task_lines GROUP BY task_id, node""") + """
SELECT task_id, node, round(span_s, 6) AS span_s, round(m, 6) AS median_s, round(span_s / m, 6) AS ratio,
       span_s / m > 1.5 AS straggler
FROM spans, (SELECT quantile_cont(span_s, 0.5) AS m FROM spans)""")
def straggler_rank(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.straggler_rank(L.task_records(fx.raw_log(spark, sf_dir)))


@register("task_failure_profile", oracle=cte(**TL) + """
SELECT task_id, count(*) AS lines, count(*) FILTER (WHERE level = 'ERROR') AS error_lines,
       round(count(*) FILTER (WHERE level = 'ERROR') / count(*), 6) AS error_rate
FROM task_lines GROUP BY task_id""")
def task_failure_profile(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.failure_profile(L.task_records(fx.raw_log(spark, sf_dir)))


@register("silence_gaps", oracle=cte(metric_sample=fx.METRIC_SAMPLE_SQL) + f"""
SELECT hostname, mode, gap_start, gap_end, round(gap_s, 6) AS gap_s FROM (
  SELECT hostname, mode, lag(ts) OVER (PARTITION BY hostname, mode ORDER BY ts, event_id) AS gap_start, ts AS gap_end,
         (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY hostname, mode ORDER BY ts, event_id))) / 1e6 AS gap_s
  FROM metric_sample)
WHERE gap_s >= {GAP_SECONDS}""")
def silence_gaps(spark: SparkSession, sf_dir: str):
    """Periods of at least six hours with no sample from a series (the daemon-stop signature)."""
    prepare(spark)
    return ops.silence_gaps(fx.metric_sample(spark, sf_dir), ["hostname", "mode"], "ts", "event_id", GAP_SECONDS)


def _ip_case(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.IP_TO_HOST.items())
    return f"CASE {expr} {whens} END"


STATIC = ", ".join(f"'{t}'" for t in dims.STATIC_LOG_TYPES)
RECLASS_SQL = f"""
SELECT event_id, log_type, original_hostname, ip, coalesce(CASE WHEN message IS NULL OR message = '' THEN NULL
                                                               ELSE coalesce({_ip_case('ip')}, ip) END,
                                                          original_hostname) AS hostname,
       CASE WHEN log_type IN ({STATIC}) THEN log_type ELSE 'task_' || log_type END AS out_name
FROM (SELECT event_id, message, coalesce(task_id, component) AS log_type, coalesce(node, 'unknown') AS original_hostname,
             nullif(regexp_extract(message, '(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1), '') AS ip
      FROM store)
"""


@register("ip_reclassify", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + RECLASS_SQL)
def ip_reclassify(spark: SparkSession, sf_dir: str):
    prepare(spark)
    rec = ops.reclassify_by_ip(L.store_records(fx.raw_log(spark, sf_dir)))
    return rec.select("event_id", "log_type", "original_hostname", "ip", "hostname", "out_name")


@register("reclass_rollup", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL, r=RECLASS_SQL)
          + "SELECT hostname, log_type, count(*) AS n FROM r GROUP BY ROLLUP (hostname, log_type)")
def reclass_rollup(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return ops.reclass_rollup(ops.reclassify_by_ip(L.store_records(fx.raw_log(spark, sf_dir))))
