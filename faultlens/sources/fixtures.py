"""Projections of the given test tables into the reference's input shapes.

Each projection has a Spark form (a lazy DataFrame over the parquet table, so
the work grows with the table) and the same projection as a DuckDB CTE body for
the oracles.  The shapes follow FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.operators.ordering import join_null_safe, materialize
from faultlens.plans import dims
from faultlens.sources.tables import read_table

# --- fixed values of the projections ------------------------------------------
LEVEL_WORD = {"error": "ERROR", "click": "INFO", "view": "DEBUG", "purchase": "WARN", "signup": "note"}
IP_TAILS = ["3.183", "1.96", "9.9"]          # by user_id % 3: known, known, unknown
STACK_LINE = "  at org.example.Frame"
TASK_CLUSTER_TS = "1700000000000"
# -------------------------------------------------------------------------------


def _slave(user_id):
    return F.concat(F.lit("cpf-"), (F.lit(2) + user_id % 3).cast("string"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed raw log lines: (event_id, ts, filename, line).

    ``ts`` is the store's ingest time (pushdown target); ``line`` is the raw text.
    """
    return raw_log_from(read_table(spark, sf_dir, "events"))


def raw_log_from(ev: DataFrame) -> DataFrame:
    """The raw-log projection of an events DataFrame (batch or streaming)."""
    e, u = F.col("event_id"), F.col("user_id")
    k = e % 8
    filename = (
        F.when(k == 0, F.concat(F.lit("/var/log/hadoop/hdfs-datanode-"), _slave(u), F.lit(".log")))
        .when(k == 1, F.lit("/var/log/hadoop/hdfs-namenode-cpf-1.log"))
        .when(k == 2, F.lit("/var/log/hadoop/hdfs-secondarynamenode-cpf-1.log"))
        .when(k == 3, F.concat(F.lit("/var/log/hadoop/yarn-nodemanager-"), _slave(u), F.lit(".log")))
        .when(k == 4, F.lit("/var/log/hadoop/yarn-resourcemanager-cpf-1.log"))
        .when(k.isin(5, 6), F.concat(
            F.lit(f"/hdfs-nfs/tmp/logs/application_{TASK_CLUSTER_TS}_"), (F.lit(1000) + e % 12).cast("string"),
            F.lit("/"), _slave(u), F.lit("_45454")))
        .otherwise(F.lit("/var/log/syslog"))
    )
    word = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_WORD.items() for x in kv]), F.col("event_type"))
    tail = F.element_at(F.array(*[F.lit(t) for t in IP_TAILS]), (u % 3 + 1).cast("int"))
    message = F.concat(word, F.lit(" from 10.10."), tail, F.lit(" "), F.col("props"))
    line = (
        F.when(e % 11 == 0, F.lit(STACK_LINE))
        .when(e % 5 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), message))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), message))
    )
    return ev.select("event_id", "ts", filename.alias("filename"), line.alias("line"))


RAW_LOG_SQL = f"""
SELECT event_id, ts,
  CASE event_id % 8
    WHEN 0 THEN '/var/log/hadoop/hdfs-datanode-cpf-' || (2 + user_id % 3) || '.log'
    WHEN 1 THEN '/var/log/hadoop/hdfs-namenode-cpf-1.log'
    WHEN 2 THEN '/var/log/hadoop/hdfs-secondarynamenode-cpf-1.log'
    WHEN 3 THEN '/var/log/hadoop/yarn-nodemanager-cpf-' || (2 + user_id % 3) || '.log'
    WHEN 4 THEN '/var/log/hadoop/yarn-resourcemanager-cpf-1.log'
    WHEN 5 THEN '/hdfs-nfs/tmp/logs/application_{TASK_CLUSTER_TS}_' || (1000 + event_id % 12) || '/cpf-' || (2 + user_id % 3) || '_45454'
    WHEN 6 THEN '/hdfs-nfs/tmp/logs/application_{TASK_CLUSTER_TS}_' || (1000 + event_id % 12) || '/cpf-' || (2 + user_id % 3) || '_45454'
    ELSE '/var/log/syslog' END AS filename,
  CASE WHEN event_id % 11 = 0 THEN '{STACK_LINE}'
       WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || msg
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || msg END AS line
FROM (SELECT *,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG'
                  WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'note' END
  || ' from 10.10.' || CASE user_id % 3 WHEN 0 THEN '3.183' WHEN 1 THEN '1.96' ELSE '9.9' END
  || ' ' || props AS msg
  FROM events) e
"""


def text_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text lines: (doc_id, line_no, line), line_no from 1."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


TEXT_LINE_SQL = """
SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
       unnest(string_split(text, chr(10))) AS line
FROM documents
"""


def skew_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew-job input lines derived from events: mostly hot_key, some cold_key and blanks."""
    ev = read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    line = (F.when(e % 200 == 0, F.lit(""))
            .when(e % 100 == 0, F.lit("cold_key"))
            .when(e % 7 == 0, F.lit("hot_key_x"))
            .otherwise(F.lit("hot_key")))
    return ev.select("event_id", line.alias("line"))


SKEW_LINE_SQL = """
SELECT event_id, CASE WHEN event_id % 200 = 0 THEN '' WHEN event_id % 100 = 0 THEN 'cold_key'
                      WHEN event_id % 7 = 0 THEN 'hot_key_x' ELSE 'hot_key' END AS line
FROM events
"""


def gauge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node-exporter-like gauge samples: (event_id, ts, hostname, mode, g)."""
    return gauge_from(read_table(spark, sf_dir, "events"))


def gauge_from(ev: DataFrame) -> DataFrame:
    """The gauge projection of an events DataFrame (batch or streaming)."""
    return ev.select(
        "event_id", "ts", F.concat(F.lit("cpf-"), (F.col("user_id") % 4 + 1).cast("string")).alias("hostname"),
        F.col("event_type").alias("mode"), F.col("value").alias("g"))


def metric_sample(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The gauge samples with a counter ``v`` that grows by the gauge and is reset daily.

    The running sum is taken inside each minute, on top of the sums of the day's minutes before it, so a
    busy (host, mode, day) is many small windows. ``since`` and ``until`` limit the days that are read.
    """
    rows = gauge_sample(spark, sf_dir)
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since[:10]).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    series = ["hostname", "mode", "day"]
    rows = rows.withColumns({"day": F.to_date("ts"), "minute": F.date_trunc("minute", "ts")})
    sums = materialize(rows.groupBy(*series, "minute").agg(F.sum("g").alias("_sum")))
    before = Window.partitionBy(*series).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*series, "minute", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*series, "minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return join_null_safe(rows, sums, [*series, "minute"]).select(
        "event_id", "ts", "hostname", "mode", "g", (F.col("_before") + F.sum("g").over(inside)).alias("v"))


METRIC_SAMPLE_SQL = """
SELECT event_id, ts, 'cpf-' || (user_id % 4 + 1) AS hostname, event_type AS mode, value AS g,
       sum(value) OVER (PARTITION BY user_id % 4, event_type, CAST(ts AS DATE)
                        ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
FROM events
"""


# --- fixed values of the run projection ---------------------------------------
FAULT_ROTATION = ["data_skew", "data_bloat", "task_fail", "long_tail", "network_latency", "cpu_load"]
SCRIPTED_FAULTS = ["data_skew", "data_bloat", "task_fail", "long_tail"]   # the others fail: no script
JOBLESS_FAULTS = ["network_latency", "cpu_load"]                          # run no job
# -------------------------------------------------------------------------------


def job_runs(task_lines: DataFrame) -> DataFrame:
    """One run per (task, day) of task-log activity: job id, fault type, script, first/last line time."""
    seq = F.split_part(F.col("task_id"), F.lit("_"), F.lit(2)).cast("long")
    runs = task_lines.groupBy("task_id", F.to_date("line_ts").alias("day")).agg(
        F.min("line_ts").alias("run_start"), F.max("line_ts").alias("run_end"))
    fault = F.element_at(F.array(*[F.lit(f) for f in FAULT_ROTATION]),
                         (F.pmod(seq + F.dayofmonth("day"), F.lit(len(FAULT_ROTATION))) + 1).cast("int"))
    runs = runs.withColumn("fault_type", fault)
    job = F.when(F.col("fault_type").isin(JOBLESS_FAULTS), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("job_"), F.col("task_id")))
    script = F.concat(F.lit("/scripts/"), F.col("fault_type"), F.lit("/inject_"), F.col("fault_type"), F.lit(".sh"))
    return runs.withColumns({"job_id": job, "script": script}).withColumns({
        "minutes_before": F.lit(dims.DEFAULT_RUN_PARAMS["minutes_before"]),
        "minutes_after": F.lit(dims.DEFAULT_RUN_PARAMS["minutes_after"]),
        "wait_minutes": F.lit(dims.DEFAULT_RUN_PARAMS["wait_minutes"]),
    })


def result_lines(runs: DataFrame) -> DataFrame:
    """A result row for each run with fault information: success where the type has a script, an error otherwise."""
    ok = F.col("fault_type").isin(SCRIPTED_FAULTS)
    no = F.lit(None)
    return runs.select(
        "fault_type", F.when(ok, F.col("job_id")).alias("job_id"),
        F.when(ok, F.concat(F.lit("/out/"), F.col("fault_type"), F.lit("/"), F.col("task_id"))).alias("task_dir"), ok.alias("success"),
        F.when(~ok, F.concat(F.lit("script missing: /scripts/"), F.col("fault_type"))).alias("error"), F.col("run_start").alias("timestamp"),
        F.when(ok, F.col("affected_nodes")).alias("affected_nodes"), F.when(ok, F.col("affected_services")).alias("affected_services"),
        F.when(ok, F.col("nodes_known")).alias("nodes_known"),
        F.when(ok, F.struct("minutes_before", "minutes_after", "wait_minutes")).otherwise(no).alias("params"))
