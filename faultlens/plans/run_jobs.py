"""Registered queries: run dataset (SRC10, J3, J4, J6, P18, P20, P21, F6, F7, W2, W4-W6, A9, A10, R5, R8)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultlens.operators import logs as L
from faultlens.operators import runs as ops
from faultlens.operators.ordering import materialize
from faultlens.operators.rangejoin import range_join
from faultlens.plans import dims
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte, register
from faultlens.plans.collect import collect_runs, count_runs
from faultlens.plans.dims import sql_values
from faultlens.session import prepare, scratch_path
from faultlens.sources import fixtures as fx
from faultlens.sources import runfiles as RF
from faultlens.sources.tables import read_table

TASK_LINES_SQL = "SELECT * FROM parsed WHERE contains(filename, 'application_') AND task_id IS NOT NULL"
ROT = "[" + ", ".join(f"'{f}'" for f in fx.FAULT_ROTATION) + "]"
JOBLESS = ", ".join(f"'{f}'" for f in fx.JOBLESS_FAULTS)
P = dims.DEFAULT_RUN_PARAMS
RUNS_SQL = f"""
SELECT *, CASE WHEN fault_type IN ({JOBLESS}) THEN NULL ELSE 'job_' || task_id END AS job_id,
       {P['minutes_before']} AS minutes_before, {P['minutes_after']} AS minutes_after, {P['wait_minutes']} AS wait_minutes
FROM (SELECT *, {ROT}[(CAST(split_part(task_id, '_', 2) AS BIGINT) + dayofmonth(day)) % {len(fx.FAULT_ROTATION)} + 1]
                AS fault_type
      FROM (SELECT task_id, CAST(line_ts AS DATE) AS day, min(line_ts) AS run_start, max(line_ts) AS run_end
            FROM task_lines GROUP BY task_id, CAST(line_ts AS DATE)))
"""
WINDOWS_SQL = """
SELECT concat_ws('_', fault_type, job_id, strftime(run_end, '%Y%m%d_%H%M%S')) AS run_id, fault_type, job_id, task_id,
       run_start, run_end,
       date_trunc('second', run_end - to_minutes(minutes_before)) AS window_start,
       date_trunc('second', run_end + to_minutes(wait_minutes + minutes_after)) AS window_end
FROM runs
"""
BASE = dict(raw_log=fx.RAW_LOG_SQL, parsed=S.PARSED_SQL, task_lines=TASK_LINES_SQL, runs=RUNS_SQL,
            windows=WINDOWS_SQL)
CATALOGUE_SQL = "SELECT * FROM " + sql_values(
    [(k, *v) for k, v in dims.FAULT_CATALOGUE.items()],
    ["fault_type", "description", "affected_nodes", "affected_services", "injection_method", "nodes_known"])
_D = dims.UNKNOWN_FAULT
_lst = lambda xs: "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"
FAULT_INFO_SQL = f"""
SELECT w.*, coalesce(c.description, '{_D[0]}') AS description,
       coalesce(c.affected_nodes, {_lst(_D[1])}) AS affected_nodes,
       coalesce(c.affected_services, {_lst(_D[2])}) AS affected_services,
       coalesce(c.injection_method, '{_D[3]}') AS injection_method,
       coalesce(c.nodes_known, {str(_D[4]).upper()}) AS nodes_known
FROM windows w LEFT JOIN catalogue c ON c.fault_type = w.fault_type
"""


def _windows(spark, sf_dir):
    raw = fx.raw_log(spark, sf_dir)
    return ops.run_windows(fx.job_runs(L.task_records(raw)))


@register("run_windows", oracle=cte(**BASE) + "SELECT * FROM windows")
def run_windows(spark: SparkSession, sf_dir: str):
    """Runs (task x day of activity) with their collection windows and folder ids."""
    prepare(spark)
    return _windows(spark, sf_dir).select("run_id", "fault_type", "job_id", "task_id", "run_start", "run_end", "window_start", "window_end")


@register("fault_dim_join", oracle=cte(**BASE, catalogue=CATALOGUE_SQL, info=FAULT_INFO_SQL) + """
SELECT run_id, fault_type, description, array_to_string(affected_nodes, ', ') AS affected_nodes,
       array_to_string(affected_services, ', ') AS affected_services, injection_method, nodes_known FROM info""")
def fault_dim_join(spark: SparkSession, sf_dir: str):
    """Runs labelled from the fault catalogue (default row for types it lacks)."""
    prepare(spark)
    info = ops.with_fault_info(_windows(spark, sf_dir))
    return info.select("run_id", "fault_type", "description",
                       F.array_join("affected_nodes", ", ").alias("affected_nodes"),
                       F.array_join("affected_services", ", ").alias("affected_services"),
                       "injection_method", "nodes_known")


STORE = dict(store=S.STORE_SQL)


COLLECTED_SQL = """
SELECT i.run_id, 'component' AS source, s.event_id, s.node, s.component, s.task_id, s.filename, s.level
FROM info i JOIN store s ON s.line_ts >= i.window_start AND s.line_ts < i.window_end
WHERE s.task_id IS NULL AND s.component <> 'unknown'
UNION ALL
SELECT f.run_id, 'task' AS source, p.event_id, p.node, p.component, p.task_id, p.filename, p.level
FROM (SELECT DISTINCT i.run_id, r.filename FROM info i JOIN raw_log r ON r.ts >= i.window_start AND r.ts < i.window_end
      WHERE contains(r.filename, 'application_')) f
JOIN parsed p ON p.filename = f.filename WHERE p.task_id IS NOT NULL
"""
COLLECTED = dict(BASE, store=S.STORE_SQL, catalogue=CATALOGUE_SQL, info=FAULT_INFO_SQL, collected=COLLECTED_SQL)


@register("labelled_records", oracle=cte(**COLLECTED) + """
SELECT c.run_id, c.source, c.event_id, c.node, c.component, c.level, i.fault_type,
       list_contains(i.affected_nodes, c.node) AS in_affected, i.nodes_known
FROM collected c JOIN info i ON i.run_id = c.run_id""")
def labelled_records(spark: SparkSession, sf_dir: str):
    """Every record collected for a run (component rows in its window, listed task files whole), labelled with its fault."""
    prepare(spark)
    raw = fx.raw_log(spark, sf_dir)
    info = materialize(ops.with_fault_info(ops.run_windows(fx.job_runs(L.task_records(raw)))).select(
        "run_id", "fault_type", "affected_nodes", "nodes_known", "window_start", "window_end"))
    rows = collect_runs(raw, info)
    return rows.select("run_id", "source", "event_id", "node", "component", "level", "fault_type",
                       F.array_contains("affected_nodes", F.col("node")).alias("in_affected"), "nodes_known")


@register("collection_totals", oracle=cte(**dict(COLLECTED, metric_sample=fx.METRIC_SAMPLE_SQL)) + """
, per_file AS (
  SELECT run_id, 'log' AS kind, coalesce('task_' || task_id, component) AS name, node, count(*) AS n FROM collected GROUP BY ALL
  UNION ALL
  SELECT i.run_id, 'metric', m.mode, m.hostname, count(*) FROM info i
  JOIN metric_sample m ON m.ts >= i.window_start AND m.ts < i.window_end GROUP BY ALL)
SELECT run_id, kind, name, node, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows FROM per_file
GROUP BY GROUPING SETS ((run_id, kind, name, node), (run_id, kind), (kind), ())""")
def collection_totals(spark: SparkSession, sf_dir: str):
    """Rows of each run's files by node, files and rows of each run, and in all."""
    prepare(spark)
    raw = fx.raw_log(spark, sf_dir)
    windows = materialize(_windows(spark, sf_dir).select("run_id", "window_start", "window_end"))
    mets = range_join(fx.gauge_sample(spark, sf_dir).select("hostname", "mode", "ts"), windows, "ts")
    return ops.collection_totals(count_runs(raw, windows), mets.select("run_id", F.col("mode").alias("name"), F.col("hostname").alias("node")))


@register("known_node_runs", oracle=cte(**BASE, catalogue=CATALOGUE_SQL, info=FAULT_INFO_SQL) + """
SELECT run_id, fault_type, array_to_string(affected_nodes, ', ') AS affected_nodes FROM info WHERE nodes_known""")
def known_node_runs(spark: SparkSession, sf_dir: str):
    """Runs whose affected nodes are known beforehand (F7)."""
    prepare(spark)
    known = ops.known_nodes(ops.with_fault_info(_windows(spark, sf_dir)))
    return known.select("run_id", "fault_type", F.array_join("affected_nodes", ", ").alias("affected_nodes"))


@register("random_node_runs", oracle=cte(**BASE, catalogue=CATALOGUE_SQL, info=FAULT_INFO_SQL) + """
SELECT run_id, fault_type FROM info WHERE NOT nodes_known""")
def random_node_runs(spark: SparkSession, sf_dir: str):
    """Runs whose affected nodes are only found at run time (F7)."""
    prepare(spark)
    return ops.known_nodes(ops.with_fault_info(_windows(spark, sf_dir)), known=False).select("run_id", "fault_type")


@register("labelled_metrics", oracle=cte(**BASE, metric_sample=fx.METRIC_SAMPLE_SQL, catalogue=CATALOGUE_SQL,
                                         info=FAULT_INFO_SQL) + """
SELECT i.run_id, m.event_id, m.hostname, m.mode, round(m.g, 6) AS g, i.fault_type,
       list_contains(i.affected_nodes, m.hostname) AS in_affected, i.nodes_known
FROM info i JOIN metric_sample m ON m.ts >= i.window_start AND m.ts < i.window_end""")
def labelled_metrics(spark: SparkSession, sf_dir: str):
    """Every metric sample inside a run's window, labelled with the run's fault (range join + dim)."""
    prepare(spark)
    raw = fx.raw_log(spark, sf_dir)
    info = ops.with_fault_info(ops.run_windows(fx.job_runs(L.task_records(raw))))
    samples = fx.gauge_sample(spark, sf_dir)
    joined = range_join(samples, info.select("run_id", "fault_type", "affected_nodes", "nodes_known",
                                             "window_start", "window_end"), "ts")
    return joined.select("run_id", "event_id", "hostname", "mode", F.round("g", 6).alias("g"), "fault_type",
                         F.array_contains("affected_nodes", F.col("hostname")).alias("in_affected"), "nodes_known")


@register("collection_summary", oracle=cte(**BASE, **STORE, metric_sample=fx.METRIC_SAMPLE_SQL,
                                           catalogue=CATALOGUE_SQL, info=FAULT_INFO_SQL) + """
SELECT w.run_id, w.fault_type, w.job_id, w.description, array_to_string(w.affected_nodes, ', ') AS affected_nodes,
       array_to_string(w.affected_services, ', ') AS affected_services, w.injection_method,
       w.window_start, w.window_end,
       coalesce(l.log_files, 0) AS log_files, coalesce(l.log_rows, 0) AS log_rows,
       coalesce(m.metric_series, 0) AS metric_series, coalesce(m.metric_rows, 0) AS metric_rows
FROM info w
LEFT JOIN (SELECT w.run_id, count(DISTINCT s.filename) AS log_files, count(*) AS log_rows
           FROM windows w JOIN store s ON s.line_ts >= w.window_start AND s.line_ts < w.window_end
           GROUP BY w.run_id) l ON l.run_id = w.run_id
LEFT JOIN (SELECT w.run_id, count(DISTINCT (m.hostname, m.mode)) AS metric_series, count(*) AS metric_rows
           FROM windows w JOIN metric_sample m ON m.ts >= w.window_start AND m.ts < w.window_end
           GROUP BY w.run_id) m ON m.run_id = w.run_id""")
def collection_summary(spark: SparkSession, sf_dir: str):
    """Per run: fault information, collection window, and log/metric files and rows collected in it."""
    prepare(spark)
    raw = fx.raw_log(spark, sf_dir)
    info = materialize(ops.with_fault_info(ops.run_windows(fx.job_runs(L.task_records(raw)))).select(
        "run_id", "fault_type", "job_id", "description", F.array_join("affected_nodes", ", ").alias("affected_nodes"),
        F.array_join("affected_services", ", ").alias("affected_services"), "injection_method",
        "window_start", "window_end"))
    windows = info.select("run_id", "window_start", "window_end")
    logs = range_join(L.store_records(raw).select("filename", "line_ts"), windows, "line_ts") \
        .groupBy("run_id").agg(F.count_distinct("filename").alias("log_files"), F.count(F.lit(1)).alias("log_rows"))
    mets = range_join(fx.gauge_sample(spark, sf_dir).select("hostname", "mode", "ts"), windows, "ts") \
        .groupBy("run_id").agg(F.count_distinct("hostname", "mode").alias("metric_series"),
                               F.count(F.lit(1)).alias("metric_rows"))
    out = info.join(logs, "run_id", "left").join(mets, "run_id", "left")
    return out.select(*info.columns, *[F.coalesce(c, F.lit(0)).alias(c)
                                       for c in ("log_files", "log_rows", "metric_series", "metric_rows")])


@register("recent_runs", oracle=cte(**BASE) + """
SELECT run_id, (SELECT count(*) FROM windows WHERE contains(run_id, '_job_')) AS total
FROM windows WHERE contains(run_id, '_job_') ORDER BY run_id DESC LIMIT 5""")
def recent_runs(spark: SparkSession, sf_dir: str):
    """Latest five run folders with a job id (name order) and how many there are (top-k)."""
    prepare(spark)
    with_job = materialize(_windows(spark, sf_dir).where(F.col("run_id").contains("_job_")))
    total = with_job.agg(F.count(F.lit(1))).scalar()
    return with_job.orderBy(F.col("run_id").desc()).limit(5).select("run_id", total.alias("total"))


CONSOLE_SQL = """
SELECT task_id, line_ts, event_id,
       CASE event_id % 3 WHEN 0 THEN 'Running job: job_' || task_id
                         WHEN 1 THEN 'Previous job_1700000000000_' || (event_id % 7) || ' done' ELSE message END AS line
FROM task_lines
"""


@register("first_job_id", oracle=cte(raw_log=fx.RAW_LOG_SQL, parsed=S.PARSED_SQL, task_lines=TASK_LINES_SQL,
                                     console=CONSOLE_SQL) + """
SELECT task_id, arg_min(regexp_extract(line, 'job_[0-9]+_[0-9]+'), (line_ts, event_id)) AS job_id
FROM console WHERE regexp_matches(line, 'job_[0-9]+_[0-9]+') GROUP BY task_id""")
def first_job_id(spark: SparkSession, sf_dir: str):
    """First job id printed in each task's console output, in line order."""
    prepare(spark)
    lines = L.task_records(fx.raw_log(spark, sf_dir))
    e = F.col("event_id")
    console = lines.select("task_id", "line_ts", "event_id", F.when(e % 3 == 0, F.concat(F.lit("Running job: job_"), F.col("task_id")))
                           .when(e % 3 == 1, F.concat(F.lit("Previous job_1700000000000_"), (e % 7).cast("string"), F.lit(" done")))
                           .otherwise(F.col("message")).alias("line"))
    return ops.first_job_id(console, ["task_id"], ["line_ts", "event_id"])


PLAN_TYPES = ["data_bloat", "task_fail", "data_skew", "long_tail", "network_latency"]


def plan_entries(spark: SparkSession, sf_dir: str):
    """Plan entries as JSON lines (one per user of the event table), read back with the plan
    schema; absent ``order``/``enabled`` fields exercise the defaults."""
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    entry = F.struct(
        F.element_at(F.array(*[F.lit(t) for t in PLAN_TYPES]), (u % 5 + 1).cast("int")).alias("type"),
        (u % 3).cast("int").alias("count"),
        F.when(u % 7 != 0, (u % 10).cast("int")).alias("order"),
        F.when(u % 5 != 0, u % 4 != 0).alias("enabled"),
        F.struct((F.lit(3) + u % 2).cast("int").alias("minutes_before"), F.lit(5).alias("minutes_after"),
                 F.lit(1).alias("wait_minutes")).alias("params"))
    text = users.select(u.alias("position"), F.to_json(entry).alias("json"))
    return text.select("position", F.from_json("json", RF.PLAN_ENTRY_SCHEMA).alias("e")).select("position", "e.*")


PLAN_SQL = f"""
WITH entries AS (
  SELECT user_id AS position, {('[' + ', '.join(repr(t) for t in PLAN_TYPES) + ']')}[user_id % 5 + 1] AS type,
         CAST(user_id % 3 AS INTEGER) AS count,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 10 AS INTEGER) END AS order_,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 4 <> 0 END AS enabled,
         CAST(3 + user_id % 2 AS INTEGER) AS minutes_before
  FROM (SELECT DISTINCT user_id FROM events)),
en AS (SELECT *, coalesce(order_, {dims.DEFAULT_ORDER}) AS order_key FROM entries WHERE coalesce(enabled, TRUE)),
reps AS (SELECT en.*, r.i FROM en, LATERAL (SELECT range AS i FROM range(1, count + 1)) r),
tot AS (SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS total FROM en)
SELECT row_number() OVER (ORDER BY order_key, position, i) AS k, tot.total, type AS fault_type, i, count,
       order_key, position, round(row_number() OVER (ORDER BY order_key, position, i) * 100.0 / tot.total, 1) AS percent,
       minutes_before, 5 AS minutes_after, 1 AS wait_minutes
FROM reps, tot
"""


@register("fault_plan", oracle=PLAN_SQL)
def fault_plan(spark: SparkSession, sf_dir: str):
    """Batch plan: enabled entries in order, one row per repetition, numbered k of total."""
    prepare(spark)
    return ops.expand_plan(plan_entries(spark, sf_dir)).withColumn("i", F.col("i").cast("long"))


@register("fault_plan_random", oracle=PLAN_SQL.replace("ORDER BY order_key, position, i",
                                                       "ORDER BY md5('42:' || position), position, i"))
def fault_plan_random(spark: SparkSession, sf_dir: str):
    """The plan in a random order that a seed fixes (W5)."""
    prepare(spark)
    return ops.expand_plan(plan_entries(spark, sf_dir), random_seed=42).withColumn("i", F.col("i").cast("long"))


RESULTS_SQL = f"""
SELECT fault_type, count(*) AS total_runs,
       count(*) FILTER (WHERE fault_type IN ({', '.join(repr(f) for f in fx.SCRIPTED_FAULTS)})) AS successful_runs,
       count(*) FILTER (WHERE fault_type NOT IN ({', '.join(repr(f) for f in fx.SCRIPTED_FAULTS)})) AS failed_runs,
       min(run_start) AS start_time
FROM runs GROUP BY ROLLUP (fault_type)
"""


def landed_results(spark: SparkSession, sf_dir: str):
    """Result rows of the runs, written as JSON lines and read back as a user's result files are."""
    runs = ops.with_fault_info(_windows(spark, sf_dir))
    path = scratch_path(spark, "run_results")
    fx.result_lines(runs).write.json(path)
    return RF.read_results(spark, path)


@register("execution_summary", oracle=cte(**BASE) + RESULTS_SQL)
def execution_summary(spark: SparkSession, sf_dir: str):
    """Outcome counts per fault type and in total (the batch summary's totals), from result files."""
    prepare(spark)
    return ops.outcome_counts(landed_results(spark, sf_dir))


@register("run_summary", oracle=cte(**BASE, catalogue=CATALOGUE_SQL, info=FAULT_INFO_SQL) + f"""
SELECT fault_type, CASE WHEN ok THEN job_id END AS job_id, CASE WHEN ok THEN '/out/' || fault_type || '/' || task_id END AS task_dir, ok AS success,
       CASE WHEN NOT ok THEN 'script missing: /scripts/' || fault_type END AS error, run_start AS timestamp,
       CASE WHEN ok THEN array_to_string(affected_nodes, ', ') END AS affected_nodes, CASE WHEN ok THEN nodes_known END AS nodes_known,
       CASE WHEN ok THEN {P['minutes_before']} END AS minutes_before,
       count(*) OVER () AS total_runs, count(*) FILTER (WHERE ok) OVER () AS successful_runs,
       count(*) FILTER (WHERE NOT ok) OVER () AS failed_runs, min(run_start) OVER () AS start_time, 4 AS planned_faults, FALSE AS random_order
FROM (SELECT *, fault_type IN ({', '.join(repr(f) for f in fx.SCRIPTED_FAULTS)}) AS ok FROM info)""")
def run_summary(spark: SparkSession, sf_dir: str):
    """The whole batch summary - result list, totals and configuration - written and read back."""
    prepare(spark)
    root = RF.write_run_summary(landed_results(spark, sf_dir), RF.default_plan(spark), scratch_path(spark, "run_summary"))
    totals = spark.read.schema("start_time timestamp_ntz, total_runs long, successful_runs long, failed_runs long").json(f"{root}/totals")
    config = spark.read.schema(RF.PLAN_SCHEMA).json(f"{root}/config").select(
        F.size("faults").alias("planned_faults"), F.col("global_settings.random_order").alias("random_order"))
    once = [t.select(c).scalar().alias(c) for t in (totals, config) for c in t.columns]   # one row each
    return RF.read_results(spark, f"{root}/results").select(
        "fault_type", "job_id", "task_dir", "success", "error", "timestamp", F.array_join("affected_nodes", ", ").alias("affected_nodes"),
        "nodes_known", F.col("params.minutes_before").alias("minutes_before"), *once)


PLAN_TYPE_OF = {"click": "data_bloat", "view": "task_fail", "purchase": "data_skew", "error": "long_tail", "signup": "network_latency"}
PLAN_FILES_SQL = f"""
WITH per AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INTEGER) AS position,
             CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PLAN_TYPE_OF.items())} END AS type, CAST(n % 4 AS INTEGER) AS count,
             CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(n % 5 AS INTEGER) END AS order_, CASE WHEN n % 7 = 0 THEN NULL ELSE n % 5 <> 0 END AS enabled,
             user_id % 2 = 1 AS random_order FROM per),
r AS (SELECT e.*, x.i FROM e, LATERAL (SELECT range AS i FROM range(1, count + 1)) x WHERE coalesce(enabled, TRUE)),
o AS (SELECT *, coalesce(order_, {dims.DEFAULT_ORDER}) AS order_key,
             CASE WHEN random_order THEN md5('42:' || position) ELSE '' END AS first FROM r)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first, CASE WHEN random_order THEN 0 ELSE order_key END, position, i) AS k,
       count(*) OVER (PARTITION BY user_id) AS total, type AS fault_type, i, order_key, position, 'entry ' || type AS description,
       4 AS minutes_before, {P['minutes_after']} AS minutes_after
FROM o"""


@register("plan_json", oracle=PLAN_FILES_SQL)
def plan_json(spark: SparkSession, sf_dir: str):
    """Plan documents (one per user of the event table, with entries and settings) landed as JSON, read and expanded."""
    prepare(spark)
    n = F.col("n")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in PLAN_TYPE_OF.items() for x in kv]), F.col("event_type"))
    entry = F.struct(
        F.col("event_type"), kind.alias("type"), (n % 4).cast("int").alias("count"), F.when(n % 3 != 0, (n % 5).cast("int")).alias("order"),
        F.when(n % 7 != 0, n % 5 != 0).alias("enabled"), F.concat(F.lit("entry "), kind).alias("description"),
        F.struct(F.lit(4).alias("minutes_before")).alias("params"))
    per = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    plans = per.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("faults"))   # at most one entry per event type
    path = scratch_path(spark, "plan_files")
    settings = F.struct(F.concat(F.lit("/out/"), F.col("user_id")).alias("output_dir"), (F.col("user_id") % 2 == 1).alias("random_order"))
    plans.select("faults", settings.alias("global_settings")).write.json(path)
    back = RF.read_plans(spark, path, multi_line=False)
    named = back.withColumn("plan", F.substring_index("global_settings.output_dir", "/", -1))
    return ops.expand_plans(RF.plan_entries(named)).select(
        F.col("plan").cast("long").alias("user_id"), "k", "total", "fault_type", "i", "order_key", "position", "description", "minutes_before",
        "minutes_after")


TOPO_SQL = f"""
SELECT t.node, t.component, t.n, coalesce(list_contains(r.roles, t.component), FALSE) AS is_role,
       (SELECT count(*) FROM {sql_values([(s, e) for s, es in dims.SERVICE_ENDPOINTS.items() for e in es], ['service', 'endpoint'])}
        WHERE service = t.component AND split_part(endpoint, ':', 1) = t.node) AS endpoints
FROM (SELECT node, component, count(*) AS n FROM store GROUP BY node, component) t
LEFT JOIN (SELECT * FROM {sql_values(list(dims.NODE_ROLES.items()), ['node', 'roles'])}) r ON r.node = t.node
"""


@register("topology", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + TOPO_SQL)
def topology(spark: SparkSession, sf_dir: str):
    """Observed (node, component) log sources checked against the node roles and service endpoints."""
    prepare(spark)
    store = L.store_records(fx.raw_log(spark, sf_dir))
    seen = store.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    roles = F.broadcast(dims.node_roles(spark))
    ends = dims.service_endpoints(spark).select("service", F.explode("endpoints").alias("endpoint")) \
        .select(F.col("service").alias("component"), F.split_part("endpoint", F.lit(":"), F.lit(1)).alias("node")) \
        .groupBy("node", "component").agg(F.count(F.lit(1)).alias("endpoints"))
    out = seen.join(roles, "node", "left").join(F.broadcast(ends), ["node", "component"], "left")
    return out.select("node", "component", "n",
                      F.coalesce(F.array_contains("roles", F.col("component")), F.lit(False)).alias("is_role"),
                      F.coalesce("endpoints", F.lit(0)).cast("long").alias("endpoints"))


@register("data_quality", oracle=cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + f"""
SELECT e.node, e.component, coalesce(a.n, 0) AS rows, coalesce(a.n, 0) > 0 AS present
FROM (SELECT node, unnest(roles) AS component FROM {sql_values(list(dims.NODE_ROLES.items()), ['node', 'roles'])}) e
LEFT JOIN (SELECT node, component, count(*) AS n FROM store GROUP BY node, component) a
  ON a.node = e.node AND a.component = e.component""")
def data_quality(spark: SparkSession, sf_dir: str):
    """Each expected (node, role) log partition: collected rows and whether it is present."""
    prepare(spark)
    store = L.store_records(fx.raw_log(spark, sf_dir))
    actual = store.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    expected = dims.node_roles(spark).select("node", F.explode("roles").alias("component"))
    out = expected.join(actual, ["node", "component"], "left")
    return out.select("node", "component", F.coalesce("n", F.lit(0)).alias("rows"),
                      (F.coalesce("n", F.lit(0)) > 0).alias("present"))
