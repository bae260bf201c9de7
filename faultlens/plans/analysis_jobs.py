"""Registered queries over the collected data: as-of join, rolling frames, merged windows, differences, SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultlens.functions.sqlfuncs import register_sql_functions
from faultlens.functions.time import epoch_micros
from faultlens.operators import intervals as I
from faultlens.operators import logs as L
from faultlens.operators.asof import asof_join
from faultlens.operators.multiset import multiset_diff
from faultlens.operators.quantiles import grouped_quantiles
from faultlens.operators.rolling import rolling_sums
from faultlens.plans import detect_jobs as DJ
from faultlens.plans import run_jobs as RJ
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte, register
from faultlens.session import prepare
from faultlens.sources import fixtures as fx

LOGS = dict(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL)
TOLERANCE_S = 1800
FRAME_S = 6 * 3600


#: The latest (or next) sample of the host; of one time the one with the greatest (smallest) event id.
ASOF_SQL = f"""
, near AS (SELECT s.event_id, m.ts, m.event_id AS sample_id, m.g,
                  row_number() OVER (PARTITION BY s.event_id ORDER BY m.ts {{order}}, m.event_id {{order}}) AS nth
           FROM store s JOIN metric_sample m ON m.hostname = s.node AND m.ts {{op}} s.line_ts
            AND m.ts BETWEEN s.line_ts - INTERVAL {TOLERANCE_S} SECOND AND s.line_ts + INTERVAL {TOLERANCE_S} SECOND)
SELECT s.event_id, s.node, s.level, n.ts AS sample_ts, n.sample_id, round(n.g, 6) AS g
FROM store s LEFT JOIN near n ON n.event_id = s.event_id AND n.nth = 1"""
METRICS = dict(LOGS, metric_sample=fx.METRIC_SAMPLE_SQL)


def _asof(spark: SparkSession, sf_dir: str, direction: str):
    prepare(spark)
    store = L.store_records(fx.raw_log(spark, sf_dir)).select("event_id", "node", "level", "line_ts")
    samples = fx.gauge_sample(spark, sf_dir).select(F.col("hostname").alias("node"), F.col("ts").alias("sample_ts"),
                                                    F.col("event_id").alias("sample_id"), "g")
    rows = asof_join(store, samples, ["node"], "line_ts", "sample_ts", "sample_id", ["sample_ts", "sample_id", "g"], direction, TOLERANCE_S)
    return rows.select("event_id", "node", "level", "sample_ts", "sample_id", F.round("g", 6).alias("g"))


@register("asof_metric", oracle=cte(**METRICS) + ASOF_SQL.format(op="<=", order="DESC"))
def asof_metric(spark: SparkSession, sf_dir: str):
    """Every log row with the latest metric sample of its node, at most half an hour old."""
    return _asof(spark, sf_dir, "backward")


@register("asof_metric_next", oracle=cte(**METRICS) + ASOF_SQL.format(op=">=", order="ASC"))
def asof_metric_next(spark: SparkSession, sf_dir: str):
    """Every log row with the next metric sample of its node, at most half an hour later."""
    return _asof(spark, sf_dir, "forward")


@register("rolling_error_rate", oracle=cte(**LOGS) + f"""
, frames AS (SELECT node, line_ts, count(*) OVER w AS n, count(*) FILTER (WHERE level = 'ERROR') OVER w AS errors FROM store
             WINDOW w AS (PARTITION BY node ORDER BY epoch_us(line_ts) RANGE BETWEEN {FRAME_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW))
SELECT DISTINCT node, line_ts, n, errors, round(errors / n, 6) AS error_rate FROM frames""")
def rolling_error_rate(spark: SparkSession, sf_dir: str):
    """Rows, error rows and their share over the last six hours of a node, at each of its log times."""
    prepare(spark)
    store = L.store_records(fx.raw_log(spark, sf_dir)).select("node", "line_ts", "level")
    sums = rolling_sums(store, ["node"], "line_ts", FRAME_S, {"n": F.lit(1), "errors": F.when(F.col("level") == "ERROR", 1).otherwise(0)})
    return sums.select("node", "line_ts", "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"))


QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
QUANTILES_SQL = ", ".join(f"round(quantile_cont({{0}}, {q}), 6) AS {name}" for name, q in QUANTILES.items())


@register("span_quantiles", oracle=cte(**DJ.TL, spans="""
SELECT task_id, node, (epoch_us(max(line_ts)) - epoch_us(min(line_ts))) / 1e6 AS span_s
FROM task_lines GROUP BY task_id, node""") + f"SELECT node, count(*) AS n, {QUANTILES_SQL.format('span_s')} FROM spans GROUP BY node")
def span_quantiles(spark: SparkSession, sf_dir: str):
    """How long a node's tasks took: median, 90th and 99th percentile of their spans."""
    prepare(spark)
    lines = L.task_records(fx.raw_log(spark, sf_dir))
    spans = lines.groupBy("task_id", "node").agg(
        ((epoch_micros(F.max("line_ts")) - epoch_micros(F.min("line_ts"))) / F.lit(1e6)).alias("span_s"))
    found = grouped_quantiles(spans, ["node"], "span_s", QUANTILES)
    return found.select("node", "n", *[F.round(q, 6).alias(q) for q in QUANTILES])


@register("gauge_quantiles", oracle=cte(metric_sample=fx.METRIC_SAMPLE_SQL) + f"""
SELECT hostname, count(*) AS n, {QUANTILES_SQL.format('g')} FROM metric_sample WHERE g IS NOT NULL GROUP BY hostname""")
def gauge_quantiles(spark: SparkSession, sf_dir: str):
    """Median, 90th and 99th percentile of each host's gauge samples."""
    prepare(spark)
    found = grouped_quantiles(fx.gauge_sample(spark, sf_dir), ["hostname"], "g", QUANTILES)
    return found.select("hostname", "n", *[F.round(q, 6).alias(q) for q in QUANTILES])


MERGED_SQL = """
, swept AS (SELECT fault_type, run_id, window_start, window_end, max(window_end) OVER (ORDER BY window_start, window_end, run_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows WHERE window_start < window_end),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR window_start > reach THEN 1 ELSE 0 END)
                       OVER (ORDER BY window_start, window_end, run_id ROWS UNBOUNDED PRECEDING) AS island FROM swept)
"""


@register("merged_windows", oracle=cte(**RJ.BASE) + MERGED_SQL + """
SELECT min(window_start) AS merged_start, max(window_end) AS merged_end, count(*) AS members
FROM numbered GROUP BY island""")
def merged_windows(spark: SparkSession, sf_dir: str):
    """Collection windows of all runs, overlapping and touching ones merged, so that nothing is collected twice."""
    prepare(spark)
    members = I.merged_membership(RJ._windows(spark, sf_dir).select("run_id", "fault_type", "window_start", "window_end"), [])
    return I.merged_windows(members, [])


@register("window_membership", oracle=cte(**RJ.BASE) + MERGED_SQL + """
SELECT run_id, fault_type, min(window_start) OVER (PARTITION BY island) AS merged_start FROM numbered""")
def window_membership(spark: SparkSession, sf_dir: str):
    """The merged window that each run's collection window is part of."""
    prepare(spark)
    members = I.merged_membership(RJ._windows(spark, sf_dir).select("run_id", "fault_type", "window_start", "window_end"), [])
    return members.select("run_id", "fault_type", "merged_start")


DIFF = "component, node, level, message"


@register("collection_diff", oracle=cte(**LOGS, parsed=S.PARSED_SQL) + f"""
, a AS (SELECT {DIFF}, count(*) AS n FROM store GROUP BY ALL), b AS (SELECT {DIFF}, count(*) AS n FROM parsed GROUP BY ALL)
SELECT coalesce(a.component, b.component) AS component, coalesce(a.node, b.node) AS node, coalesce(a.level, b.level) AS level,
       coalesce(a.message, b.message) AS message, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
FROM a FULL JOIN b ON a.component IS NOT DISTINCT FROM b.component AND a.node IS NOT DISTINCT FROM b.node
 AND a.level IS NOT DISTINCT FROM b.level AND a.message IS NOT DISTINCT FROM b.message
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def collection_diff(spark: SparkSession, sf_dir: str):
    """What differs between the log as stored and as parsed from its lines, row by row with counts."""
    prepare(spark)
    raw = fx.raw_log(spark, sf_dir)
    return multiset_diff(L.store_records(raw), L.parse_lines(raw), DIFF.split(", "))


@register("sql_log_tag", oracle=cte(raw_log=fx.RAW_LOG_SQL, parsed=S.PARSED_SQL)
          + "SELECT event_id, filename, component, node, task_id, line_ts, level, message FROM parsed")
def sql_log_tag(spark: SparkSession, sf_dir: str):
    """Log lines tagged and parsed in SQL alone, with the session's log functions."""
    prepare(spark)
    register_sql_functions(spark)
    return spark.sql("""
        SELECT event_id, filename, log_component(filename) AS component, log_node(filename) AS node, log_task_id(filename) AS task_id,
               f.line_ts, log_level(f.message) AS level, f.message
        FROM {raw}, LATERAL log_fields(line) AS f""", raw=fx.raw_log(spark, sf_dir))
