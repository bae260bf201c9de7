"""Run dataset: job runs, collection windows, fault labels, plans and outcome summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions import runs as R
from faultlens.operators.ordering import global_order_number, materialize, materialize_sized, maybe_broadcast
from faultlens.plans import dims

def run_windows(runs: DataFrame) -> DataFrame:
    """Collection window per run: [end - before, end + wait + after), second precision;
    run folder id ``<fault>_<job>_<yyyyMMdd_HHmmss>`` (job part skipped when absent)."""
    end = F.col("run_end")
    start = F.date_trunc("second", F.timestamp_add("MINUTE", -F.col("minutes_before"), end)).cast("timestamp_ntz")
    stop = F.date_trunc("second", F.timestamp_add("MINUTE", F.col("wait_minutes") + F.col("minutes_after"), end)) \
        .cast("timestamp_ntz")
    run_id = R.run_folder(F.col("fault_type"), F.col("job_id"), F.date_format(end, "yyyyMMdd_HHmmss"))
    kept = [c for c in ("script", "minutes_before", "minutes_after", "wait_minutes") if c in runs.columns]
    return runs.select(run_id.alias("run_id"), "fault_type", "job_id", "task_id", "run_start", "run_end",
                       start.alias("window_start"), stop.alias("window_end"), *kept)


def with_fault_info(runs: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Attach the fault catalogue; unknown types get the default row.

    Runs with a ``script`` column take the type from the script's path, others from ``fault_type``.  ``catalogue`` has
    the columns of :data:`dims.FAULT_SCHEMA`; without one the built-in table is used.  A catalogue of the user's own
    is broadcast only within the measured budget.
    """
    if catalogue is None:
        cat = F.broadcast(dims.fault_catalogue(runs.sparkSession))
    else:
        cat, seen = materialize_sized(catalogue.select(*dims.FAULT_SCHEMA.fieldNames()))
        cat = maybe_broadcast(cat, rows=seen["rows"], size=seen["bytes"])
    kind = R.fault_from_script(F.col("script")) if "script" in runs.columns else F.col("fault_type")
    d = dims.UNKNOWN_FAULT
    joined = runs.withColumn("_ft", kind).join(cat.withColumnRenamed("fault_type", "_ft"), "_ft", "left")
    return joined.withColumns({
        "description": F.coalesce("description", F.lit(d[0])),
        "affected_nodes": F.coalesce("affected_nodes", F.array(*[F.lit(x) for x in d[1]]).cast("array<string>")),
        "affected_services": F.coalesce("affected_services", F.array(*[F.lit(x) for x in d[2]])),
        "injection_method": F.coalesce("injection_method", F.lit(d[3])),
        "nodes_known": F.coalesce("nodes_known", F.lit(d[4])),
    }).drop("_ft")


def first_job_id(lines: DataFrame, group_cols: list[str], order_cols: list[str], line_col: str = "line") -> DataFrame:
    """First ``job_<n>_<n>`` mentioned in each group's output, in line order (min of a struct:
    algebraic, so partial aggregation bounds every group)."""
    found = lines.select(*group_cols, *order_cols, R.job_id_in_line(F.col(line_col)).alias("_job")) \
        .where(F.col("_job").isNotNull())
    return found.groupBy(*group_cols).agg(F.min(F.struct(*order_cols, "_job")).alias("_f")) \
        .select(*group_cols, F.col("_f._job").alias("job_id"))


def expand_plan(entries: DataFrame, position_col: str = "position", random_seed: int | None = None) -> DataFrame:
    """Run plan: enabled entries (absent = enabled), ordered by ``order`` (absent = 999) and
    file position - or by a seeded hash - one row per repetition, numbered k of total."""
    # the plan is small; one materialisation serves the total, the range sampling and numbering
    enabled = materialize(entries.where(F.coalesce(F.col("enabled"), F.lit(True))))
    reps = enabled.withColumn("order_key", F.coalesce(F.col("order"), F.lit(dims.DEFAULT_ORDER))) \
        .withColumn("i", F.explode(F.when(F.col("count") > 0, F.sequence(F.lit(1), F.col("count")))
                                   .otherwise(F.array().cast("array<int>"))))
    total = enabled.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    if random_seed is None:
        order = [F.col("order_key"), F.col(position_col), F.col("i")]
    else:
        seeded = F.concat(F.lit(f"{random_seed}:"), F.col(position_col).cast("string"))
        reps = reps.withColumn("_shuffle", F.md5(seeded.cast("binary")))
        order = [F.col("_shuffle"), F.col(position_col), F.col("i")]
    numbered = global_order_number(reps, order, col="k")
    return numbered.select(
        "k", total.cast("long").alias("total"), F.col("type").alias("fault_type"), "i", "count", "order_key",
        position_col, F.round(F.col("k") * F.lit(100.0) / total, 1).alias("percent"),
        F.coalesce("params.minutes_before", F.lit(dims.DEFAULT_RUN_PARAMS["minutes_before"])).alias("minutes_before"),
        F.coalesce("params.minutes_after", F.lit(dims.DEFAULT_RUN_PARAMS["minutes_after"])).alias("minutes_after"),
        F.coalesce("params.wait_minutes", F.lit(dims.DEFAULT_RUN_PARAMS["wait_minutes"])).alias("wait_minutes"))


def expand_plans(entries: DataFrame, random_seed: int = 42) -> DataFrame:
    """Every plan's runs, numbered ``k`` of ``total`` inside the plan.

    Entries as :func:`faultlens.sources.runfiles.plan_entries` gives them.  A plan with ``random_order`` is ordered by a
    seeded hash of its entries.  A plan is one document, so one window per plan is bounded by that document.
    """
    enabled = entries.where(F.coalesce("enabled", F.lit(True)))
    seeded = F.md5(F.concat(F.lit(f"{random_seed}:"), F.col("position").cast("string")).cast("binary"))
    reps = enabled.withColumns({
        "order_key": F.coalesce("order", F.lit(dims.DEFAULT_ORDER)),
        "_first": F.when(F.col("random_order"), seeded).otherwise(F.lit("")),
        "i": F.explode(F.when(F.col("count") > 0, F.sequence(F.lit(1), F.col("count"))).otherwise(F.array().cast("array<int>")))})
    whole = Window.partitionBy("plan")
    number = F.row_number().over(whole.orderBy("_first", F.when(F.col("random_order"), 0).otherwise(F.col("order_key")), "position", "i"))
    out = reps.withColumns({"k": number.cast("long"), "total": F.count(F.lit(1)).over(whole)})
    p = dims.DEFAULT_RUN_PARAMS
    return out.select("plan", "k", "total", F.col("type").alias("fault_type"), F.col("i").cast("long").alias("i"), "count", "order_key", "position",
                      "description", F.round(F.col("k") * F.lit(100.0) / F.col("total"), 1).alias("percent"),
                      *[F.coalesce(f"params.{c}", F.lit(p[c])).alias(c) for c in p])


def known_nodes(runs: DataFrame, known: bool = True) -> DataFrame:
    """Runs whose affected nodes are known beforehand, or (``known=False``) only found at run time."""
    return runs.where(F.coalesce("nodes_known", F.lit(False)) == F.lit(known))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Total / successful / failed runs per fault type plus the grand total (rollup); absent ``success`` is a failure."""
    ok = F.coalesce("success", F.lit(False))
    return results.rollup("fault_type").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(ok).alias("successful_runs"),
        F.count_if(~ok).alias("failed_runs"),
        F.min("timestamp").alias("start_time"))


def collection_totals(logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """``run_id, kind, name, node, files, rows``: rows of each run's file on each node, then files and rows of each run, of each
    kind and overall (the finer columns are NULL there).

    ``logs(run_id, name, node, rows)`` as :func:`faultlens.plans.collect.count_runs` gives them, ``metrics(run_id, name, node)`` a
    row per sample.
    """
    samples = metrics.groupBy("run_id", "name", "node").agg(F.count(F.lit(1)).alias("rows"))
    per_file = materialize(logs.withColumn("kind", F.lit("log")).unionByName(samples.withColumn("kind", F.lit("metric"))))
    return per_file.groupingSets([["run_id", "kind", "name", "node"], ["run_id", "kind"], ["kind"], []], "run_id", "kind", "name", "node").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
