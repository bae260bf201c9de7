"""Metric-store range-query responses built from landed samples, and their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.time import epoch_micros

METRIC_RESPONSE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("value", T.ArrayType(T.StringType())),
        ]))),
    ])),
])

# Two queries are answered from each sample: a counter and a gauge.
COUNTER_QUERY = "node_cpu_seconds_total{job='node'}"
GAUGE_QUERY = "node_memory_MemFree_bytes"
BAD_VALUE_EVERY = 89          # these rows carry a non-numeric value (dropped on read)
UNLABELLED_MODE = "signup"    # series of this mode carry no ``mode`` label
DEVICE_MODE = "view"          # series of this mode carry ``device="sda"``
NO_HOST = ("cpf-4", "signup")  # this series has an empty instance (dropped on read)


def metric_responses(samples: DataFrame, page_rows: int = 100) -> DataFrame:
    """One JSON body per (query, page of ``page_rows`` event ids): ``(query, page, body)``.

    A series with a single point in a page is sent in the instant ``value`` form.
    """
    unix = (epoch_micros("ts") / F.lit(1e6)).cast("string")
    instance = F.when((F.col("hostname") == NO_HOST[0]) & (F.col("mode") == NO_HOST[1]), F.lit("")) \
        .otherwise(F.concat(F.col("hostname"), F.lit(":9100")))
    labels = F.map_filter(F.create_map(
        F.lit("instance"), instance,
        F.lit("mode"), F.when(F.col("mode") != UNLABELLED_MODE, F.col("mode")),
        F.lit("device"), F.when(F.col("mode") == DEVICE_MODE, F.lit("sda"))), lambda k, v: v.isNotNull())
    base = samples.select((F.col("event_id") / page_rows).cast("long").alias("page"), "event_id",
                          "hostname", "mode", labels.alias("labels"), unix.alias("unix"), "v", "g")
    both = base.select("*", F.explode(F.array(
        F.struct(F.lit(COUNTER_QUERY).alias("query"), F.col("v").alias("val")),
        F.struct(F.lit(GAUGE_QUERY).alias("query"), F.col("g").alias("val")))).alias("q"))
    text = F.when(F.col("event_id") % BAD_VALUE_EVERY == 0, F.lit("x")).otherwise(F.col("q.val").cast("string"))
    points = both.select(F.col("q.query").alias("query"), "page", "hostname", "mode", "labels", "event_id",
                         F.array("unix", text).alias("point"))
    series = points.groupBy("query", "page", "hostname", "mode").agg(
        F.first("labels").alias("metric"),
        F.sort_array(F.collect_list(F.struct("event_id", "point"))).alias("pts"))
    single = F.size("pts") == 1
    series = series.select(
        "query", "page", "metric",
        F.when(single, F.array().cast("array<array<string>>"))
         .otherwise(F.transform("pts", lambda p: p["point"])).alias("values"),
        F.when(single, F.col("pts")[0]["point"]).alias("value"))
    pages = series.groupBy("query", "page").agg(F.collect_list(F.struct("metric", "values", "value")).alias("result"))
    body = F.to_json(F.struct(F.lit("success").alias("status"),
                              F.struct(F.lit("matrix").alias("resultType"), F.col("result").alias("result"))
                              .alias("data")))
    return pages.select("query", "page", body.alias("body"))
