"""Log-store response pages (the query API's JSON) built from landed rows, and their schema.

Pages group at most ``page_rows`` consecutive rows (by ``event_id``) so no page,
stream or value list grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions import logs as L
from faultlens.functions.time import epoch_nanos

LOG_RESPONSE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("stream", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
        ]))),
    ])),
])

BAD_TIME_EVERY = 97          # every 97th row carries a non-integer time (dropped on read)
UNLABELLED_PATH = "/var/log/syslog"   # streams of this path carry no level label


def log_responses(store: DataFrame, page_rows: int = 100) -> DataFrame:
    """One JSON page per block of ``page_rows`` store rows: ``(page, body)``."""
    level = F.when(F.col("filename") == UNLABELLED_PATH, F.lit(None)).otherwise(
        L.level_from_message(F.col("line")))
    ns = F.when(F.col("event_id") % BAD_TIME_EVERY == 0, F.lit("bad")).otherwise(
        epoch_nanos("ts").cast("string"))
    rows = store.select((F.col("event_id") / page_rows).cast("long").alias("page"), "event_id", "filename",
                        level.alias("level"), ns.alias("ns"), "line")
    streams = rows.groupBy("page", "filename", "level").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "ns", "line"))).alias("vals"))
    streams = streams.select(
        "page",
        F.map_filter(F.create_map(F.lit("filename"), F.col("filename"), F.lit("level"), F.col("level")),
                     lambda k, v: v.isNotNull()).alias("stream"),
        F.transform("vals", lambda x: F.array(x["ns"], x["line"])).alias("values"))
    pages = streams.groupBy("page").agg(F.collect_list(F.struct("stream", "values")).alias("result"))
    body = F.to_json(F.struct(F.lit("success").alias("status"),
                              F.struct(F.lit("streams").alias("resultType"), F.col("result").alias("result"))
                              .alias("data")))
    return pages.select("page", body.alias("body"))


def read_response_lines(spark, path: str, body_col: str = "body") -> DataFrame:
    """Landed API responses, one JSON document per line (as a scraper appends them).

    A line is either a bare response or an envelope ``{"query": ..., "response": {...}}``
    (metric collectors keep the query text: the metric name comes from it).  Returns
    ``(query, body)``; ``query`` is NULL for bare responses.  Line-delimited files split
    across tasks; no whole-file reads."""
    raw = spark.read.text(path)
    response = F.get_json_object(F.col("value"), "$.response")
    return raw.select(F.get_json_object(F.col("value"), "$.query").alias("query"),
                      F.coalesce(response, F.col("value")).alias(body_col))


def envelope_lines(pages: DataFrame, query_col: str = "query", body_col: str = "body") -> DataFrame:
    """``(query, body)`` pages as envelope lines ``{"query": ..., "response": ...}`` (``value``)."""
    head = F.to_json(F.struct(F.col(query_col).alias("query")))          # {"query":"..."} - escaped
    return pages.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"response":'), F.col(body_col),
                                 F.lit("}")).alias("value"))
