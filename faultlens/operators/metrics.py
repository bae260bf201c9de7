"""Metric ETL: response flatten, label derivation, step-aligned instant values, counter increase/rate.

Time-series evaluation without one task per series.  Samples outside the evaluated range are
filtered first, by literal times that reach the scan.  Instant values keep the latest sample of each
(series, step) - an aggregate with map-side combine - and only those are carried to later grid
points.  Counter windows send a sample to the grid points whose window contains it and aggregate
algebraic pieces (min/max-by on one ordering number, sums, counts) in hash aggregates.  That fan-out
is bounded by ``window / step``, a fixed parameter, not by the data.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions import metrics as M
from faultlens.functions.time import epoch_micros, from_epoch_micros, ts_text_s
from faultlens.operators.ordering import with_previous
from faultlens.plans import dims

#: Seconds since 1970 up to the year 9999 either way.
MAX_UNIX = 253_402_300_800


def flatten_metric_responses(responses: DataFrame, query_col: str = "query", body_col: str = "body",
                             instance_hosts: dict | None = None, service_ports: dict | None = None) -> DataFrame:
    """Range-query JSON -> one row per sample with metric name/category and labels.

    Empty ``values`` falls back to the single ``value``; non-numeric values and series
    whose host resolves to ``unknown`` are dropped.
    """
    from faultlens.sources.metricstore import METRIC_RESPONSE_SCHEMA
    instance_hosts = instance_hosts or dims.INSTANCE_TO_HOST
    service_ports = service_ports or dims.SERVICE_PORTS
    doc = F.from_json(F.col(body_col), METRIC_RESPONSE_SCHEMA)
    query = F.col(query_col) if query_col in responses.columns else F.lit(None).cast("string")
    series = responses.select(query.alias("query"), F.explode(doc["data"]["result"]).alias("r"))
    pts = F.when(F.size("r.values") > 0, F.col("r.values")) \
        .when(F.col("r.value").isNotNull(), F.array(F.col("r.value"))) \
        .otherwise(F.array().cast("array<array<string>>"))
    labels = F.col("r.metric")
    instance = F.coalesce(F.element_at(labels, F.lit("instance")), F.lit(""))
    # the name comes from the query text; without one, from the series' __name__ label
    rows = series.select(
        F.coalesce(M.metric_name(F.col("query")), F.element_at(labels, F.lit("__name__"))).alias("metric"),
        M.host_from_instance(instance, instance_hosts).alias("hostname"),
        M.service_from_instance(instance, service_ports).alias("service"),
        M.label(labels, "device").alias("device"),
        M.label(labels, "mode").alias("mode"),
        M.label(labels, "mountpoint").alias("mountpoint"),
        F.explode(pts).alias("p"),
    ).where(F.col("hostname") != "unknown")
    unix = F.get("p", 0).try_cast("double")
    value = F.get("p", 1).try_cast("double")
    # a time that is no number, NaN or beyond the range of microseconds has no place on the time axis
    micros = F.when(F.abs(unix) < F.lit(MAX_UNIX), F.round(unix * F.lit(1e6)).try_cast("long"))
    out = rows.select("*", unix.alias("timestamp_unix"), value.alias("value"), micros.alias("timestamp_us")) \
        .where(F.col("timestamp_us").isNotNull() & F.col("value").isNotNull())
    return out.select(ts_text_s(from_epoch_micros(F.col("timestamp_us"))).alias("timestamp"), "timestamp_unix", "timestamp_us",
                      "metric", M.metric_category(F.col("metric")).alias("category"),
                      "hostname", "service", "device", "mode", "mountpoint", "value")


def label_instances(df: DataFrame, instance_col: str = "instance", query_col: str = "query",
                    categories: list[str] | None = None, instance_hosts: dict | None = None,
                    service_ports: dict | None = None) -> DataFrame:
    """Host/service from the instance label, metric name/category from the query text, and
    category pruning: only queries of the requested catalogue categories are kept (semi join)."""
    categories = categories or dims.DEFAULT_METRIC_CATEGORIES
    instance_hosts = instance_hosts or dims.INSTANCE_TO_HOST
    service_ports = service_ports or dims.SERVICE_PORTS
    catalogue = dims.metric_catalogue(df.sparkSession).where(F.col("category").isin(categories))
    kept = df.join(F.broadcast(catalogue.select(F.col("query").alias(query_col))), query_col, "left_semi")
    inst = F.col(instance_col)
    return kept.withColumns({
        "hostname": M.host_from_instance(inst, instance_hosts),
        "service": M.service_from_instance(inst, service_ports),
        "metric": M.metric_name(F.col(query_col)),
    }).withColumn("category", M.metric_category(F.col("metric")))


def _grid_points(ts_us: Column, start_us: int, end_us: int, step_us: int, window_us: int) -> Column:
    """Grid indices k (t = start + k*step, t <= end) with t - window < ts <= t."""
    k_max_grid = (end_us - start_us) // step_us
    lo = -F.floor((F.lit(start_us) - ts_us) / F.lit(step_us))              # ceil((ts - start)/step)
    hi = -F.floor((F.lit(start_us) - ts_us - F.lit(window_us)) / F.lit(step_us)) - F.lit(1)
    lo = F.greatest(lo, F.lit(0)).cast("long")
    hi = F.least(hi, F.lit(k_max_grid)).cast("long")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))


def _between(samples: DataFrame, ts_col: str, after_us: int, until_us: int) -> DataFrame:
    """Samples with ``after < ts <= until``: literal comparisons on the stored time, pushed to the scan."""
    def at(us):
        return from_epoch_micros(F.lit(us))
    return samples.where((F.col(ts_col) > at(after_us)) & (F.col(ts_col) <= at(until_us)))


def _order(us: Column, tiebreak: Column) -> Column:
    """(time, integer tiebreak) as one ordering number: a fixed-width value, so that max_by stays a hash aggregate."""
    return us.cast("decimal(38,0)") * F.lit(Decimal(20_000_000_000_000_000_000)) + tiebreak.cast("decimal(20,0)")


def _us(ts: str) -> int:
    import datetime as dt
    d = dt.datetime.fromisoformat(ts).replace(tzinfo=dt.timezone.utc)
    return int(d.timestamp()) * 1_000_000 + d.microsecond


def instant_values(samples: DataFrame, series: list[str], value_col: str, start: str, end: str,
                   step_seconds: int, lookback_seconds: int, ts_col: str = "ts",
                   tiebreak: str = "event_id") -> DataFrame:
    """Step-aligned instant value: at each grid time t in [start, end], the latest sample of
    the series with t - lookback < ts <= t; no row when there is none."""
    start_us, end_us = _us(start), _us(end)
    step_us, lb_us = step_seconds * 1_000_000, lookback_seconds * 1_000_000
    near = _between(samples, ts_col, start_us - lb_us, end_us)
    us = epoch_micros(ts_col)
    step = F.greatest(-F.floor((F.lit(start_us) - us) / F.lit(step_us)), F.lit(0)).cast("long")
    latest = near.select(*series, step.alias("_k"), us.alias("_us"), _order(us, F.col(tiebreak)).alias("_o"),
                         F.col(value_col).alias("_v")) \
        .groupBy(*series, "_k").agg(F.max("_us").alias("_us"), F.max_by("_v", "_o").alias("_v"))
    # carried until the next step with a sample, the end of the grid or of the look-back
    until = F.least(F.lead("_k").over(Window.partitionBy(*series).orderBy("_k")) - 1, F.lit((end_us - start_us) // step_us),
                    (-F.floor((F.lit(start_us) - F.col("_us") - F.lit(lb_us)) / F.lit(step_us)) - 1).cast("long"))
    steps = latest.withColumn("_until", until).where("_k <= _until").withColumn("_k", F.explode(F.expr("sequence(_k, _until)")))
    t = from_epoch_micros(F.lit(start_us) + F.col("_k") * F.lit(step_us))
    return steps.select(*series, t.alias("t"), from_epoch_micros(F.col("_us")).alias("sample_ts"), F.col("_v").alias("value"))


def counter_windows(samples: DataFrame, series: list[str], value_col: str, start: str, end: str,
                    step_seconds: int, range_seconds: int, ts_col: str = "ts",
                    tiebreak: str = "event_id") -> DataFrame:
    """Per series and grid time t, the pieces of a counter over (t - range, t]:
    first/last value and time, sample count, and the sum of values lost at resets."""
    start_us, end_us = _us(start), _us(end)
    step_us, rng_us = step_seconds * 1_000_000, range_seconds * 1_000_000
    # a sample before the first window is in none, and as a previous value it never counts as a reset
    samples = _between(samples, ts_col, start_us - rng_us, end_us)
    # bucket no narrower than the window: per-(series, bucket) carry rows stay far fewer than samples
    prev = with_previous(samples.select(*series, ts_col, tiebreak, value_col), series, ts_col, tiebreak,
                         [value_col], bucket_seconds=max(3600, range_seconds))
    us = epoch_micros(ts_col)
    fanned = prev.select(*series, us.alias("_us"), _order(us, F.col(tiebreak)).alias("_o"), F.col(value_col).alias("_v"),
                         epoch_micros("prev_" + ts_col).alias("_pus"), F.col("prev_" + value_col).alias("_pv"),
                         F.explode(_grid_points(us, start_us, end_us, step_us, rng_us)).alias("_k"))
    t_us = F.lit(start_us) + F.col("_k") * F.lit(step_us)
    reset = F.when((F.col("_pus") > t_us - F.lit(rng_us)) & (F.col("_v") < F.col("_pv")), F.col("_pv"))
    return fanned.groupBy(*series, "_k").agg(
        F.min("_us").alias("_first_us"), F.min_by("_v", "_o").alias("_first_v"),
        F.max("_us").alias("_last_us"), F.max_by("_v", "_o").alias("_last_v"),
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum(reset), F.lit(0.0)).alias("resets"),
    ).select(*series, from_epoch_micros(F.lit(start_us) + F.col("_k") * F.lit(step_us)).alias("t"),
             (F.lit(start_us) + F.col("_k") * F.lit(step_us)).alias("_t_us"),
             "_first_us", "_first_v", "_last_us", "_last_v", "samples", "resets")


def counter_increase(samples: DataFrame, series: list[str], value_col: str, start: str, end: str,
                     step_seconds: int, range_seconds: int, **kw) -> DataFrame:
    """Reset-corrected increase over each window (no extrapolation); needs two samples."""
    w = counter_windows(samples, series, value_col, start, end, step_seconds, range_seconds, **kw)
    inc = F.col("_last_v") - F.col("_first_v") + F.col("resets")
    return w.where(F.col("samples") >= 2).select(*series, "t", "samples", inc.alias("increase"))


def counter_rate(samples: DataFrame, series: list[str], value_col: str, start: str, end: str,
                 step_seconds: int, range_seconds: int, extrapolate: bool = True, **kw) -> DataFrame:
    """Per-second rate over each window; with ``extrapolate`` the increase is stretched to the
    window edges the way the metric store does (1.1 x mean spacing threshold, half spacing
    beyond it, start clipped at the counter's zero point)."""
    w = counter_windows(samples, series, value_col, start, end, step_seconds, range_seconds, **kw)
    w = w.where(F.col("samples") >= 2)
    inc = F.col("_last_v") - F.col("_first_v") + F.col("resets")
    if not extrapolate:
        return w.select(*series, "t", "samples", (inc / F.lit(float(range_seconds))).alias("rate"))
    sampled = (F.col("_last_us") - F.col("_first_us")) / F.lit(1e6)
    avg_gap = F.try_divide(sampled, F.col("samples") - F.lit(1))
    to_start0 = (F.col("_first_us") - (F.col("_t_us") - F.lit(range_seconds * 1_000_000))) / F.lit(1e6)
    to_end = (F.col("_t_us") - F.col("_last_us")) / F.lit(1e6)
    to_zero = sampled * F.try_divide(F.col("_first_v"), F.col("_inc"))
    to_start = F.when((F.col("_inc") > 0) & (F.col("_first_v") >= 0) & (to_zero < to_start0), to_zero) \
        .otherwise(to_start0)
    threshold = avg_gap * F.lit(1.1)
    stretch = (sampled
               + F.when(F.col("_to_start") < threshold, F.col("_to_start")).otherwise(avg_gap / 2)
               + F.when(to_end < threshold, to_end).otherwise(avg_gap / 2))
    return (w.withColumn("_inc", inc).withColumn("_to_start", to_start)
            .select(*series, "t", "samples",
                    # two samples at one instant (sampled = 0) give NULL, not an ANSI error
                    (F.col("_inc") * F.try_divide(stretch, sampled) / F.lit(float(range_seconds))).alias("rate")))
