"""Registered queries over rough input: NULL groups and times, odd folder names, bad sample times, full nanoseconds.

The same operators as elsewhere, on a projection of the event table where such rows are common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.time import epoch_micros
from faultlens.operators import detect as D
from faultlens.operators import logs as L
from faultlens.operators import metrics as M
from faultlens.operators.ordering import running_rank, top_n_per_group
from faultlens.plans.catalog import cte, register
from faultlens.session import prepare, scratch_path
from faultlens.sinks.files import read_partitioned_csv, write_partitioned_csv
from faultlens.sources.tables import read_table

# --- fixed values of the projection ---------------------------------------------
HOSTS = [None, "", "007", "a b%20c", "__empty__", "2024-01-01"]     # by event_id % 7; 6 is the event type
NO_TIME_EVERY = 13
BAD_TIMES = ["NaN", "Infinity", "1e30", "x"]                        # by event_id % 9; the others are true times
GAP_SECONDS = 4 * 3600
TOP = 20
# ---------------------------------------------------------------------------------

_CASES = " ".join(f"WHEN {k} THEN " + ("NULL" if h is None else f"'{h}'") for k, h in enumerate(HOSTS))
ROUGH_SQL = f"""
SELECT event_id, CASE WHEN event_id % {NO_TIME_EVERY} = 0 THEN NULL ELSE ts END AS ts,
       CASE event_id % 7 {_CASES} ELSE event_type END AS host, value
FROM events
"""
ROUGH = dict(rough=ROUGH_SQL)


def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with NULL, empty, numeric, blank-holding and date-like hosts, and without a time in places."""
    e = F.col("event_id")
    host = F.col("event_type")
    for k, h in enumerate(HOSTS):
        host = F.when(e % 7 == k, F.lit(h).cast("string")).otherwise(host)
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.when(e % NO_TIME_EVERY != 0, F.col("ts")).alias("ts"), host.alias("host"), "value")


@register("rough_rank", oracle=cte(**ROUGH) + """
SELECT event_id, host, row_number() OVER (PARTITION BY host ORDER BY ts NULLS FIRST, event_id) AS rank FROM rough""")
def rough_rank(spark: SparkSession, sf_dir: str):
    """W3 with NULL groups and times."""
    prepare(spark)
    return running_rank(rough(spark, sf_dir), ["host"], "ts", "event_id").select("event_id", "host", "rank")


@register("rough_topn", oracle=cte(**ROUGH) + f"""
SELECT event_id, host, rank FROM (
  SELECT event_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY ts NULLS FIRST, event_id) AS INTEGER) AS rank FROM rough)
WHERE rank <= {TOP}""")
def rough_topn(spark: SparkSession, sf_dir: str):
    """W1 with NULL groups and times."""
    prepare(spark)
    return top_n_per_group(rough(spark, sf_dir), ["host"], "ts", "event_id", TOP).select("event_id", "host", "rank")


@register("rough_gaps", oracle=cte(**ROUGH) + f"""
SELECT host, gap_start, gap_end, round(gap_s, 6) AS gap_s FROM (
  SELECT host, lag(ts) OVER w AS gap_start, ts AS gap_end, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_s
  FROM rough WINDOW w AS (PARTITION BY host ORDER BY ts NULLS FIRST, event_id))
WHERE gap_s >= {GAP_SECONDS}""")
def rough_gaps(spark: SparkSession, sf_dir: str):
    """R4 with NULL groups and times."""
    prepare(spark)
    return D.silence_gaps(rough(spark, sf_dir), ["host"], "ts", "event_id", GAP_SECONDS)


@register("rough_csv_roundtrip", oracle=cte(**ROUGH) + "SELECT event_id, host, value, epoch_us(ts) AS ts_us FROM rough")
def rough_csv_roundtrip(spark: SparkSession, sf_dir: str):
    """SNK1-SNK4 with folder names that look like numbers or dates, are empty or NULL, or hold blanks and percent signs."""
    prepare(spark)
    rows = rough(spark, sf_dir).select("event_id", "host", "value", epoch_micros("ts").alias("ts_us"))
    path = scratch_path(spark, "rough_csv")
    write_partitioned_csv(rows, path, ["host"], ["ts_us", "event_id"], salt_source="event_id", rows_per_writer=500)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("ts_us", T.LongType())])
    return read_partitioned_csv(spark, path, schema, ["host"]).select("event_id", "host", "value", "ts_us")


@register("rough_metric_flatten", oracle=cte(**ROUGH) + f"""
SELECT epoch_us(ts) // 1000 * 1000 AS timestamp_us, 'cpf-2' AS hostname, 'node_load1' AS metric, round(value, 6) AS value
FROM rough WHERE ts IS NOT NULL AND event_id % 9 >= {len(BAD_TIMES)}""")
def rough_metric_flatten(spark: SparkSession, sf_dir: str):
    """SRC7 with sample times that are NaN, infinite, out of range or no number."""
    prepare(spark)
    e = F.col("event_id")
    millis = F.expr("(unix_micros(cast(ts as timestamp)) div 1000)").cast("decimal(20,3)") / F.lit(1000).cast("decimal(4,0)")
    at = millis.cast("decimal(20,3)").cast("string")
    for k, bad in enumerate(BAD_TIMES):
        at = F.when(e % 9 == k, F.lit(bad)).otherwise(at)
    value = F.array(at, F.col("value").cast("string"))
    series = F.struct(F.create_map(F.lit("instance"), F.lit("cpf-2:9100")).alias("metric"), F.array(value).alias("values"))
    body = F.to_json(F.struct(F.struct(F.array(series).alias("result")).alias("data")))
    pages = rough(spark, sf_dir).select(F.lit("node_load1").alias("query"), body.alias("body"))
    return M.flatten_metric_responses(pages).select("timestamp_us", "hostname", "metric", F.round("value", 6).alias("value"))


@register("rough_stream_flatten", oracle=cte(**ROUGH) + """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, epoch_us(ts) * 1000 + 999 AS timestamp_ns, 'datanode' AS component, 'cpf-2' AS node,
       'e' || event_id AS message
FROM rough WHERE ts IS NOT NULL""")
def rough_stream_flatten(spark: SparkSession, sf_dir: str):
    """SRC5 with full nanoseconds, which a division as DOUBLE rounds up to the next second in places."""
    prepare(spark)
    ns = (epoch_micros("ts") * F.lit(1000) + F.lit(999)).cast("string")
    value = F.array(F.coalesce(ns, F.lit("none")), F.concat(F.lit("e"), F.col("event_id").cast("string")))
    labels = F.create_map(F.lit("filename"), F.lit("/var/log/hadoop/hdfs-datanode-cpf-2.log"))
    stream = F.struct(labels.alias("stream"), F.array(value).alias("values"))
    body = F.to_json(F.struct(F.struct(F.array(stream).alias("result")).alias("data")))
    rows = L.flatten_log_responses(rough(spark, sf_dir).select(body.alias("body")))
    return rows.select("timestamp", "timestamp_ns", "component", "node", "message")
