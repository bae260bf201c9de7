"""Streams with state over several micro-batches and restarts: equal to the batch result, late rows left out, state bounded."""

import datetime as dt

from pyspark.sql import functions as F

from faultlens.session import scratch_path
from faultlens.streaming import logs as st
from faultlens.streaming import state

T0 = dt.datetime(2024, 1, 1)


def land(spark, folder, name, rows, schema):
    spark.createDataFrame([(*r[:-1], T0 + dt.timedelta(minutes=r[-1])) for r in rows], schema).coalesce(1).write.parquet(f"{folder}/{name}")


def arrivals(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet") \
        .option("maxFilesPerTrigger", 1).parquet(folder)


LOG = "file string, message string, ts timestamp_ntz"


def test_a_file_collected_again_gives_each_row_once_after_a_restart_too(spark):
    base = scratch_path(spark, "test_dedup")
    first = [("f", "m1", 0), ("f", "m1", 0), ("f", None, 5), ("g", "m1", 0)]
    land(spark, base + "/land", "1", first, LOG)
    land(spark, base + "/land", "2", first + [("f", "m2", 20)], LOG)

    def run():
        once = state.first_collected(arrivals(spark, base + "/land", LOG), ["file", "message", "ts"], "ts", "1 hour")
        st.run_available_now(once, base + "/out", base + "/ckpt")
        return sorted((r.file, str(r.message), r.ts.minute) for r in spark.read.parquet(base + "/out").collect())
    want = [("f", "None", 5), ("f", "m1", 0), ("f", "m2", 20), ("g", "m1", 0)]
    assert run() == want
    land(spark, base + "/land", "3", first + [("f", "m3", 30)], LOG)   # landed after the stop: the checkpoint knows the rows
    assert run() == sorted(want + [("f", "m3", 30)])


def test_silence_alarms_wait_for_late_rows(spark):
    base = scratch_path(spark, "test_silence")
    schema = "node string, ts timestamp_ntz"

    def run():
        alarms = state.silence_alarms(arrivals(spark, base + "/land", schema), ["node"], "ts", "10 minutes", "5 minutes")
        done = st.run_available_now(alarms, base + "/out", base + "/ckpt")
        return done, sorted((r.node, (r.last_seen - T0).seconds // 60, r.n) for r in spark.read.parquet(base + "/out").collect())
    land(spark, base + "/land", "1", [("a", 0), ("a", 3), ("b", 1), ("b", 12)], schema)
    assert run()[1] == []                                    # nothing has been silent long enough for the watermark
    land(spark, base + "/land", "2", [("a", 9), ("b", 14)], schema)     # in time: it prolongs a's session
    assert run()[1] == []
    land(spark, base + "/land", "3", [("b", 40)], schema)
    assert run()[1] == [("a", 9, 3), ("b", 1, 1), ("b", 14, 2)]
    land(spark, base + "/land", "4", [("a", 11), ("b", 41)], schema)    # too late: a's alarm has been given
    done, rows = run()
    assert rows == [("a", 9, 3), ("b", 1, 1), ("b", 14, 2)] and done.late_rows == 1


def test_windows_and_logs_as_two_streams(spark):
    base = scratch_path(spark, "test_windows")
    logs, windows = "node string, id int, line_ts timestamp_ntz", "run string, node string, window_start timestamp_ntz, window_end timestamp_ntz"
    minutes = list(range(0, 600, 7))
    for k in range(3):
        land(spark, base + "/logs", str(k), [("ab"[m % 2], m, m) for m in minutes[k::3]] if k == 3 else
             [("ab"[m % 2], m, m) for m in minutes[k * 30:(k + 1) * 30]], logs)
    spans = [("r1", "a", 0, 100), ("r2", "b", 50, 55), ("r3", "a", 119, 121), ("r4", "b", 200, 599), ("r5", "a", 30, 30)]
    for k in range(2):
        part = [(r, n, T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=e)) for r, n, s, e in spans[k * 3:(k + 1) * 3]]
        spark.createDataFrame(part, windows).coalesce(1).write.parquet(f"{base}/windows/{k}")
    rows = state.windowed_rows(arrivals(spark, base + "/logs", logs), arrivals(spark, base + "/windows", windows), ["node"], watermark="12 hours")
    st.run_available_now(rows.select("run", "id"), base + "/out", base + "/ckpt")
    got = sorted((r.run, r.id) for r in spark.read.parquet(base + "/out").collect())
    assert got == sorted((r, m) for r, n, s, e in spans for m in minutes if "ab"[m % 2] == n and s <= m < e)


def test_state_of_past_windows_is_dropped(spark):
    base = scratch_path(spark, "test_state")
    logs, windows = "node string, id int, line_ts timestamp_ntz", "run string, node string, window_start timestamp_ntz, window_end timestamp_ntz"
    for day in range(4):
        land(spark, base + "/logs", str(day), [("a", day * 100 + k, day * 1440 + k * 10) for k in range(100)], logs)
        start = T0 + dt.timedelta(days=day)
        spark.createDataFrame([(f"r{day}", "a", start, start + dt.timedelta(hours=2))], windows).coalesce(1).write.parquet(f"{base}/windows/{day}")
    rows = state.windowed_rows(arrivals(spark, base + "/logs", logs), arrivals(spark, base + "/windows", windows), ["node"])
    q = (rows.select("run", "id").writeStream.format("parquet").option("checkpointLocation", base + "/ckpt")
         .trigger(availableNow=True).start(base + "/out"))
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 350 and held[-1] <= 110               # four days of rows arrived, the state holds the last ones
    assert spark.read.parquet(base + "/out").count() == 4 * 12
