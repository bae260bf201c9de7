"""Registered queries: metric ETL (SRC6-SRC7, P12-P16, J2, J7, F4-F5, A7, U2, TS1-TS3)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultlens.operators import metrics as ops
from faultlens.plans import dims
from faultlens.plans.catalog import cte, register
from faultlens.session import prepare
from faultlens.sources import fixtures as fx
from faultlens.sources import metricstore as ms
from faultlens.sources.tables import read_table

# Evaluation grid over the whole month of the test series (about one sample per 86 minutes per series):
GRID_START, GRID_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
STEP_S, LOOKBACK_S, RATE_RANGE_S = 3600, 7200, 21600
COUNTER_SINCE = "2023-12-31 18:00:00"      # the grid's start less the rate range
RECENT_MINUTES = 30

MS = dict(metric_sample=fx.METRIC_SAMPLE_SQL)
GRID_SQL = (f"SELECT unnest(generate_series(TIMESTAMP '{GRID_START}', TIMESTAMP '{GRID_END}', "
            f"INTERVAL {STEP_S} SECOND)) AS t")

FLAT_SQL = f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, epoch_us(ts) AS timestamp_us, metric, category, hostname,
       'node_exporter' AS service, CASE WHEN mode = '{ms.DEVICE_MODE}' THEN 'sda' ELSE '' END AS device,
       CASE WHEN mode = '{ms.UNLABELLED_MODE}' THEN '' ELSE mode END AS mode, '' AS mountpoint, round(val, 6) AS value
FROM (SELECT *, 'node_cpu_seconds_total' AS metric, 'cpu' AS category, v AS val FROM metric_sample
      UNION ALL
      SELECT *, 'node_memory_MemFree_bytes' AS metric, 'memory' AS category, g AS val FROM metric_sample)
WHERE event_id % {ms.BAD_VALUE_EVERY} <> 0 AND NOT (hostname = '{ms.NO_HOST[0]}' AND mode = '{ms.NO_HOST[1]}')
"""


def _flat(spark, sf_dir):
    flat = ops.flatten_metric_responses(ms.metric_responses(fx.metric_sample(spark, sf_dir)))
    return flat.drop("timestamp_unix").withColumn("value", F.round("value", 6))


@register("metric_flatten", oracle=cte(**MS) + FLAT_SQL)
def metric_flatten(spark: SparkSession, sf_dir: str):
    """Range-query pages (two queries, both response forms) flattened to sample rows."""
    prepare(spark)
    return _flat(spark, sf_dir)


@register("metric_counts", oracle=cte(**MS, flat=FLAT_SQL)
          + "SELECT hostname, metric, count(*) AS n FROM flat GROUP BY hostname, metric")
def metric_counts(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return _flat(spark, sf_dir).groupBy("hostname", "metric").agg(F.count(F.lit(1)).alias("n"))


ALL_QUERIES = [q for qs in dims.METRIC_CATALOGUE.values() for q in qs]
PORT_BY_TYPE = {"click": ":9100", "view": ":9401", "purchase": ":9404", "error": ":9999", "signup": ""}


def _sql_case(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LABELS_SQL = f"""
SELECT event_id, instance, hostname, service, query, metric,
       CASE WHEN contains(metric, 'cpu') OR contains(metric, 'load') THEN 'cpu'
            WHEN contains(metric, 'memory') OR contains(metric, 'swap') OR contains(metric, 'buffer')
                 OR contains(metric, 'cache') THEN 'memory'
            WHEN contains(metric, 'disk') OR contains(metric, 'filesystem') OR contains(metric, 'io_') THEN 'disk'
            WHEN contains(metric, 'network') THEN 'network' ELSE 'other' END AS category
FROM (SELECT event_id, instance, query, split_part(query, '{{', 1) AS metric,
        CASE WHEN instance IS NULL OR instance = '' THEN 'unknown'
             ELSE coalesce({_sql_case('instance', dims.INSTANCE_TO_HOST)}, split_part(instance, ':', 1)) END AS hostname,
        CASE WHEN instance IS NULL OR instance = '' OR NOT contains(instance, ':') THEN 'unknown'
             ELSE coalesce({_sql_case("split_part(instance, ':', 2)", dims.SERVICE_PORTS)},
                           'port_' || split_part(instance, ':', 2)) END AS service
      FROM (SELECT event_id, 'cpf-' || (user_id % 4 + 1) || {_sql_case('event_type', PORT_BY_TYPE)} AS instance,
                   [{', '.join(_sql_str(q) for q in ALL_QUERIES)}][event_id % {len(ALL_QUERIES)} + 1] AS query
            FROM events))
WHERE query IN ({', '.join(_sql_str(q) for c in dims.DEFAULT_METRIC_CATEGORIES for q in dims.METRIC_CATALOGUE[c])})
"""


@register("metric_labels", oracle=LABELS_SQL)
def metric_labels(spark: SparkSession, sf_dir: str):
    """Instance -> host/service, query -> metric/category, pruned to the requested categories."""
    prepare(spark)
    ev = read_table(spark, sf_dir, "events")
    port = F.element_at(ops.M.literal_map(PORT_BY_TYPE), F.col("event_type"))
    instance = F.concat(F.lit("cpf-"), (F.col("user_id") % 4 + 1).cast("string"), port)
    query = F.element_at(F.array(*[F.lit(q) for q in ALL_QUERIES]), (F.col("event_id") % len(ALL_QUERIES) + 1).cast("int"))
    base = ev.select("event_id", instance.alias("instance"), query.alias("query"))
    return ops.label_instances(base).select("event_id", "instance", "hostname", "service", "query", "metric", "category")


@register("metric_instant", oracle=cte(**MS, grid=GRID_SQL) + f"""
SELECT m.hostname, m.mode, g.t, max(m.ts) AS sample_ts, round(arg_max(m.g, m.ts), 6) AS value
FROM grid g JOIN metric_sample m ON m.ts <= g.t AND m.ts > g.t - INTERVAL {LOOKBACK_S} SECOND
GROUP BY m.hostname, m.mode, g.t""")
def metric_instant(spark: SparkSession, sf_dir: str):
    """Gauge value at each grid step (latest sample within the look-back)."""
    prepare(spark)
    out = ops.instant_values(fx.gauge_sample(spark, sf_dir), ["hostname", "mode"], "g", GRID_START, GRID_END,
                             STEP_S, LOOKBACK_S)
    return out.withColumn("value", F.round("value", 6))


COUNTER_SQL = f"""
s AS (SELECT hostname, mode, ts, event_id, v,
             lag(v) OVER (PARTITION BY hostname, mode ORDER BY ts, event_id) AS pv,
             lag(ts) OVER (PARTITION BY hostname, mode ORDER BY ts, event_id) AS pts FROM metric_sample),
j AS (SELECT s.*, g.t FROM grid g JOIN s ON s.ts <= g.t AND s.ts > g.t - INTERVAL {RATE_RANGE_S} SECOND),
w AS (SELECT hostname, mode, t, count(*) AS samples,
             arg_min(v, ts) AS first_v, arg_max(v, ts) AS last_v,
             epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(t) AS t_us,
             coalesce(sum(CASE WHEN pts > t - INTERVAL {RATE_RANGE_S} SECOND AND v < pv THEN pv END), 0) AS resets
      FROM j GROUP BY hostname, mode, t HAVING count(*) >= 2)
"""


@register("metric_increase", oracle=cte(**MS, grid=GRID_SQL) + ", " + COUNTER_SQL.strip() + """
SELECT hostname, mode, t, samples, round(last_v - first_v + resets, 6) AS increase FROM w""")
def metric_increase(spark: SparkSession, sf_dir: str):
    """Reset-corrected counter increase per window (no extrapolation)."""
    prepare(spark)
    out = ops.counter_increase(fx.metric_sample(spark, sf_dir, COUNTER_SINCE, GRID_END), ["hostname", "mode"], "v", GRID_START, GRID_END,
                               STEP_S, RATE_RANGE_S)
    return out.withColumn("increase", F.round("increase", 6))


@register("metric_rate", oracle=cte(**MS, grid=GRID_SQL) + ", " + COUNTER_SQL.strip() + f""",
x AS (SELECT *, last_v - first_v + resets AS inc, (last_us - first_us) / 1e6 AS sampled,
             (last_us - first_us) / 1e6 / (samples - 1) AS avg_gap,
             (first_us - (t_us - {RATE_RANGE_S * 1000000})) / 1e6 AS to_start0,
             (t_us - last_us) / 1e6 AS to_end FROM w),
y AS (SELECT *, CASE WHEN inc > 0 AND first_v >= 0 AND sampled * (first_v / inc) < to_start0
                     THEN sampled * (first_v / inc) ELSE to_start0 END AS to_start FROM x)
SELECT hostname, mode, t, samples,
       round(inc * ((sampled + CASE WHEN to_start < avg_gap * 1.1 THEN to_start ELSE avg_gap / 2 END
                             + CASE WHEN to_end < avg_gap * 1.1 THEN to_end ELSE avg_gap / 2 END) / sampled)
             / {float(RATE_RANGE_S)}, 6) AS rate
FROM y""")
def metric_rate(spark: SparkSession, sf_dir: str):
    """Per-second counter rate with edge extrapolation."""
    prepare(spark)
    out = ops.counter_rate(fx.metric_sample(spark, sf_dir, COUNTER_SINCE, GRID_END), ["hostname", "mode"], "v", GRID_START, GRID_END,
                           STEP_S, RATE_RANGE_S, extrapolate=True)
    return out.withColumn("rate", F.round("rate", 6))


@register("recent_minutes", oracle=cte(**MS) + f"""
SELECT event_id, ts, hostname, mode, round(g, 6) AS g FROM metric_sample
WHERE ts >= (SELECT max(ts) FROM metric_sample) - INTERVAL {RECENT_MINUTES} MINUTE""")
def recent_minutes(spark: SparkSession, sf_dir: str):
    """Samples of the last N minutes before the newest sample (anchor = scalar subquery)."""
    prepare(spark)
    ms_df = fx.gauge_sample(spark, sf_dir)
    ev = read_table(spark, sf_dir, "events")
    anchor = ev.agg(F.max("ts")).scalar()
    recent = ms_df.where(F.col("ts") >= anchor - F.expr(f"INTERVAL {RECENT_MINUTES} MINUTES"))
    return recent.select("event_id", "ts", "hostname", "mode", F.round("g", 6).alias("g"))
