"""Streaming over several micro-batches: equals batch on closed windows; late data dropped."""

import datetime as dt

from pyspark.sql import functions as F

from faultlens.operators import logs as L
from faultlens.session import scratch_path
from faultlens.sources import fixtures as fx
from faultlens.sources.tables import read_table
from faultlens.streaming import logs as st

SF = "/root/testdata/sf0.01"


def test_window_counts_multi_batch_with_late_file(spark):
    ev = read_table(spark, SF, "events")
    land = scratch_path(spark, "stream_land")
    # three files in arrival order: Jan 1-9, Jan 10-30, then a late file with Jan 5 rows again
    parts = [ev.where(F.col("ts") < "2024-01-10"), ev.where(F.col("ts") >= "2024-01-10"),
             ev.where(F.to_date("ts") == F.lit("2024-01-05").cast("date")).withColumn("event_id", F.col("event_id") + 10**9)]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{land}/batch={i}")
    stream = spark.readStream.schema(st.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(land)
    counts = st.window_counts(L.store_records(fx.raw_log_from(stream)), "line_ts", ["component", "node"],
                              "1 hour", "1 minute")
    out = scratch_path(spark, "stream_out")
    done = st.run_available_now(counts, out + "/data", out + "/ckpt")
    late = fx.raw_log_from(parts[2])
    # one dropped partial count for each late (hour, component, node): partial aggregation runs before the watermark test
    groups = L.store_records(late).groupBy(F.date_trunc("hour", "line_ts"), "component", "node").count().count()
    assert done.input_rows >= ev.count() and done.late_rows == groups > 0
    got = {(r.window_start, r.component, r.node): r.n for r in spark.read.parquet(out + "/data").collect()}

    on_time = L.store_records(fx.raw_log_from(ev))
    max_ts = ev.agg(F.max("ts")).first()[0]
    want_rows = (on_time.groupBy(F.window(F.col("line_ts").cast("timestamp"), "1 hour").alias("w"), "component", "node")
                 .count().where(F.col("w.end") <= F.lit(max_ts - dt.timedelta(minutes=1))).collect())
    want = {(r.w.start, r.component, r.node): r["count"] for r in want_rows}
    assert got == want          # the late Jan-5 file contributed nothing
    assert len(got) > 1000


def test_stream_to_csv_layout_equals_batch(spark):
    from faultlens.plans.collect import LOG_FILE_COLUMNS
    from faultlens.sinks.files import read_partitioned_csv
    from pyspark.sql import types as T
    sf = "/root/testdata/sf0.001"
    root = scratch_path(spark, "stream_csv")
    records = st.tag_stream(st.stream_raw_log(spark, sf))
    st.stream_to_csv_layout(records, root + "/data", root + "/ckpt")
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("event_id", "timestamp_ns") else T.StringType())
                           for c in LOG_FILE_COLUMNS])
    back = read_partitioned_csv(spark, root + "/data", schema, ["node", "log_file"])
    got = sorted((r.event_id, r.node, r.message) for r in back.collect())
    want = sorted((r.event_id, r.node, r.message) for r in L.parse_lines(fx.raw_log(spark, sf)).collect())
    assert got == want and len(got) > 0
