"""The user's own run files: plans (``faults[]`` and settings), run results, and classified CSV trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators.ordering import materialize, materialize_sized, maybe_broadcast
from faultlens.plans import dims
from faultlens.sources.files import real_path

PARAMS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("minutes_before", "minutes_after", "wait_minutes")])
PLAN_ENTRY_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("order", T.IntegerType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("description", T.StringType()),
    T.StructField("params", PARAMS),
])
PLAN_SCHEMA = T.StructType([
    T.StructField("faults", T.ArrayType(PLAN_ENTRY_SCHEMA)),
    T.StructField("global_settings", T.StructType([
        T.StructField("output_dir", T.StringType()),
        T.StructField("random_order", T.BooleanType()),
        T.StructField("interval_between_faults", T.IntegerType()),
        T.StructField("interval_between_runs", T.IntegerType()),
    ])),
])
RESULT_SCHEMA = T.StructType([
    T.StructField("fault_type", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("task_dir", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("affected_nodes", T.ArrayType(T.StringType())),
    T.StructField("affected_services", T.ArrayType(T.StringType())),
    T.StructField("nodes_known", T.BooleanType()),
    T.StructField("params", PARAMS),
])
# --- fixed values: the plan that runs when none is given ------------------------
DEFAULT_PLAN_ENTRIES = [("data_bloat", 2, 1, True), ("task_fail", 2, 2, True), ("data_skew", 2, 3, True), ("long_tail", 1, 4, False)]
#: Columns beyond this are not looked for in a header (the CSV parser's own limit).
MAX_CSV_COLUMNS = 16_384
DEFAULT_PLAN_SETTINGS = ("/tmp/fault_test_results", False, 120, 300)
# --------------------------------------------------------------------------------


def read_plans(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """``plan, faults, global_settings`` of plan files: a JSON document per file, or per line with ``multi_line=False``.

    Each file or line is one plan. ``plan`` is the path, for lines with their place: the start of the file block that the line
    was read in and its number among the rows of that read. Equal plans stay apart; places are fixed by a
    checkpoint. Blank lines are no plans.
    """
    path = real_path(F.col("_metadata.file_path"))
    if multi_line:
        rows = spark.read.schema(PLAN_SCHEMA).option("multiLine", "true").json(paths)
        return rows.select(path.alias("plan"), "faults", "global_settings")
    lines = spark.read.text(paths).select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    # the lower 33 bits of the place count the rows of a task
    placed = materialize(lines.withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)).where(F.trim("value") != ""))
    name = F.concat_ws("#", "path", F.concat_ws(":", "block", "place"))
    return placed.select(name.alias("plan"), F.from_json("value", PLAN_SCHEMA).alias("p")).select("plan", "p.faults", "p.global_settings")


def default_plan(spark: SparkSession) -> DataFrame:
    """The built-in plan, as :func:`read_plans` gives one."""
    p = dims.DEFAULT_RUN_PARAMS
    params = (p["minutes_before"], p["minutes_after"], p["wait_minutes"])
    faults = [(kind, count, order, enabled, None, params) for kind, count, order, enabled in DEFAULT_PLAN_ENTRIES]
    schema = T.StructType([T.StructField("plan", T.StringType()), *PLAN_SCHEMA.fields])
    return spark.createDataFrame([("default", faults, DEFAULT_PLAN_SETTINGS)], schema)


def plan_entries(plans: DataFrame) -> DataFrame:
    """One row per entry: ``plan, position`` (from 0), the entry's fields, and the plan's ``random_order``."""
    return plans.select("plan", F.coalesce("global_settings.random_order", F.lit(False)).alias("random_order"),
                        F.posexplode("faults").alias("position", "e")).select("plan", "random_order", "position", "e.*")


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Run results, one JSON object per line (failed runs have only type, success, error and time)."""
    return spark.read.schema(RESULT_SCHEMA).json(paths)


def write_run_summary(results: DataFrame, config: DataFrame, root: str) -> str:
    """``<root>/results`` (JSON lines), ``<root>/totals`` and ``<root>/config``: the batch summary's parts.

    The result list stays a table: one document with all runs inside would have to be built by one task.
    """
    lines = results.select(*RESULT_SCHEMA.fieldNames())
    lines.write.mode("overwrite").json(f"{root}/results")
    totals = lines.agg(F.min("timestamp").alias("start_time"), F.count(F.lit(1)).alias("total_runs"),
                       F.count_if(F.coalesce("success", F.lit(False))).alias("successful_runs"),
                       F.count_if(~F.coalesce("success", F.lit(False))).alias("failed_runs"))
    totals.write.mode("overwrite").json(f"{root}/totals")
    config.select(*PLAN_SCHEMA.fieldNames()).write.mode("overwrite").json(f"{root}/config")
    return root


def read_csv_by_header(spark: SparkSession, paths: str | list[str], columns: dict[str, str | None], width: int = 64) -> DataFrame:
    """Rows of CSV files at any depth, by the column names in each file's own header, its first record.

    ``columns`` maps the wanted names to their default where a file has no such column (a file may have none of them: its rows
    hold the defaults); files may order and omit columns as they like, further ones are ignored, and of columns
    of one name the last counts. Only the first record of a file is its header: rows that repeat it stay. A cell that a
    short row lacks is NULL. ``file`` is the path. ``width`` is how many columns are read at first; it is doubled until
    every header fits.
    """
    while True:
        cells = [f"_c{k}" for k in range(width)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
        raw = (spark.read.schema(schema).option("header", "false").option("multiLine", "true").option("escape", '"')
               .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("nullValue", "\\N").csv(paths))
        rows = raw.select(real_path(F.col("_metadata.file_path")).alias("file"), F.array(*cells).alias("cells"))
        # a multi-line file is one split, read in order by one task: its first row has the smallest number
        first = rows.withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("cells", "at").alias("header"))
        headers, seen = materialize_sized(first, full=F.max(F.size(F.filter(F.slice("header", width // 2 + 1, width), lambda c: c.isNotNull()))))
        if not seen["full"] or width >= MAX_CSV_COLUMNS:
            break
        width *= 2
    joined = rows.join(maybe_broadcast(headers, rows=seen["rows"], size=seen["bytes"]), "file")
    same = F.col("cells").eqNullSafe(F.col("header"))
    # rows equal to the header are alike: all but one of them are data
    again = joined.where(same).groupBy("file", "header").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "file", F.col("header").alias("cells"), "header", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).drop("col")
    body = joined.where(~same).select("file", "cells", "header").unionByName(again)

    def cell(name: str, default: str | None):
        at = F.lit(width) - F.array_position(F.reverse("header"), F.lit(name))
        return F.when(F.array_contains(F.coalesce("header", F.array()), F.lit(name)), F.get("cells", at.cast("int"))) \
            .otherwise(F.lit(default).cast("string")).alias(name)

    return body.select("file", *[cell(n, d) for n, d in columns.items()])
