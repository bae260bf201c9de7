"""Hand-computed time-series cases: grid ties, staleness, resets, extrapolated rate."""

import datetime as dt

import pytest

from faultlens.operators import metrics as M

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _samples(spark, pts):
    rows = [(i, T0 + dt.timedelta(seconds=s), "h", v) for i, (s, v) in enumerate(pts)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host string, v double")


def test_instant_tie_and_staleness(spark):
    df = _samples(spark, [(0, 1.0), (60, 2.0), (400, 3.0)])
    out = M.instant_values(df, ["host"], "v", "2024-01-01 00:00:00", "2024-01-01 00:10:00", 60, 300)
    got = {r.t: r.value for r in out.collect()}
    # sample exactly on the 00:01 grid point counts; 00:06 is 300 s after 00:01 -> stale (left-open look-back)
    assert got[T0] == 1.0 and got[T0 + dt.timedelta(minutes=1)] == 2.0
    assert got[T0 + dt.timedelta(minutes=5)] == 2.0
    assert T0 + dt.timedelta(minutes=6) not in got
    assert got[T0 + dt.timedelta(minutes=7)] == 3.0


def test_increase_with_reset_and_single_sample(spark):
    df = _samples(spark, [(10, 5.0), (20, 8.0), (30, 2.0), (40, 4.0), (200, 9.0)])
    out = M.counter_increase(df, ["host"], "v", "2024-01-01 00:00:40", "2024-01-01 00:04:00", 200, 60)
    got = {r.t: (r.samples, r.increase) for r in out.collect()}
    # window (-20s, 40s]: 5, 8, 2, 4 -> 4 - 5 + 8 (reset) = 7
    assert got[T0 + dt.timedelta(seconds=40)] == (4, 7.0)
    # window (180s, 240s]: one sample -> no point
    assert T0 + dt.timedelta(seconds=240) not in got


def test_rate_extrapolation_hand_case(spark):
    # samples at 15, 30, 45 s with values 10, 20, 30; window (0, 60], range 60 s
    df = _samples(spark, [(15, 10.0), (30, 20.0), (45, 30.0)])
    out = M.counter_rate(df, ["host"], "v", "2024-01-01 00:01:00", "2024-01-01 00:01:00", 60, 60).first()
    # increase 20 over 30 s sampled; avg gap 15, threshold 16.5; to_zero = 30*10/20 = 15 = to_start (15) ->
    # to_start 15 < 16.5 extends by 15; to_end 15 < 16.5 extends by 15 -> 60 s; 20 * 60/30 / 60
    assert out.rate == pytest.approx(20 * (60 / 30) / 60)
    far = _samples(spark, [(40, 10.0), (50, 20.0)])
    r2 = M.counter_rate(far, ["host"], "v", "2024-01-01 00:01:00", "2024-01-01 00:01:00", 60, 60).first()
    # sampled 10, avg 10, threshold 11; to_start 40 -> zero point 10*10/10=10 < 40 -> 10 (< 11, extend 10);
    # to_end 10 < 11 extend 10 -> 30 s; 10 * 30/10 / 60
    assert r2.rate == pytest.approx(10 * 3 / 60)


def test_flatten_real_shaped_metric_response(spark):
    import math
    body = ('{"status":"success","data":{"resultType":"matrix","result":['
            '{"metric":{"__name__":"node_load1","instance":"cpf-2:9100"},'
            '"values":[[1704067207.179,"0.5"],[1704067222.179,"NaN"],[1704067237.179,"+Inf"],[1704067252.179,"x"]]},'
            '{"metric":{"instance":"cpf-9:9404","device":"sda"},"value":[1704067207,"7"]},'
            '{"metric":{"instance":""},"values":[[1704067207,"1"]]}]}}')
    df = spark.createDataFrame([("node_load1", body)], "query string, body string")
    rows = M.flatten_metric_responses(df).orderBy("timestamp_us").collect()
    # ordered by time: the instant-form point (…207.000) first; "x" and the blank-instance series dropped
    assert [(r.hostname, r.service) for r in rows] == [("cpf-9", "nodemanager"), ("cpf-2", "node_exporter"),
                                                       ("cpf-2", "node_exporter"), ("cpf-2", "node_exporter")]
    assert rows[0].timestamp == "2024-01-01 00:00:07" and rows[0].timestamp_us == 1704067207000000
    assert rows[1].timestamp_us == 1704067207179000
    values = [r.value for r in rows]
    assert values[0] == 7.0 and values[1] == 0.5 and math.isnan(values[2]) and values[3] == float("inf")
    assert rows[0].device == "sda" and rows[1].device == "" and rows[1].category == "cpu"


def test_flatten_real_shaped_log_response(spark):
    from faultlens.operators.logs import flatten_log_responses
    body = ('{"status":"success","data":{"resultType":"streams","result":['
            '{"stream":{"filename":"/var/log/hadoop/hdfs-datanode-cpf-2.log","level":"info"},'
            '"values":[["1704067207179575000","2024-01-01 00:00:07,179 INFO ok"],["oops","dropped"]]},'
            '{"stream":{"filename":"/hdfs-nfs/x/application_1_2/cpf-3_1"},"values":[["1704067207000000000","task"]]},'
            '{"stream":{"filename":"/var/log/syslog"},"values":[["1704067208000000000","no level label"]]}]}}')
    rows = flatten_log_responses(spark.createDataFrame([(body,)], "body string")).orderBy("timestamp_ns").collect()
    assert [(r.component, r.node, r.level, r.timestamp) for r in rows] == [
        ("datanode", "cpf-2", "info", "2024-01-01 00:00:07"), ("mapreduce", "unknown", "unknown", "2024-01-01 00:00:08")]


def test_rate_with_duplicate_instant_is_null_not_error(spark):
    rows = [(0, T0 + dt.timedelta(seconds=30), "h", 1.0), (1, T0 + dt.timedelta(seconds=30), "h", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host string, v double")
    out = M.counter_rate(df, ["host"], "v", "2024-01-01 00:01:00", "2024-01-01 00:01:00", 60, 60).collect()
    assert len(out) == 1 and out[0].rate is None


def test_instant_at_the_usual_step(spark):
    """300 s look-back on a 15 s grid: a sample is carried to the next one or to the end of the look-back."""
    pts = [(0, 1.0), (7, 2.0), (30, 3.0), (500, 4.0)]
    out = M.instant_values(_samples(spark, pts), ["host"], "v", "2024-01-01 00:00:00", "2024-01-01 00:15:00", 15, 300)
    want = {}
    for k in range(61):
        t = 15 * k
        near = [(s, v) for s, v in pts if t - 300 < s <= t]
        if near:
            want[T0 + dt.timedelta(seconds=t)] = max(near)[1]
    assert {r.t: r.value for r in out.collect()} == want


def test_equal_times_take_the_larger_tiebreak(spark):
    df = spark.createDataFrame([(2, T0, "h", 5.0), (9, T0, "h", 6.0), (-4, T0, "h", 7.0)], "event_id long, ts timestamp_ntz, host string, v double")
    out = M.instant_values(df, ["host"], "v", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 60, 300)
    assert [r.value for r in out.collect()] == [6.0]


def test_bad_sample_times_are_dropped(spark):
    body = ('{"data":{"result":[{"metric":{"instance":"cpf-2:9100"},"values":'
            '[["NaN","1"],["Infinity","1"],["1e30","1"],[null,"1"],["x","1"],[1704067207,"2"]]}]}}')
    df = spark.createDataFrame([("node_load1", body)], "query string, body string")
    assert [(r.timestamp_us, r.value) for r in M.flatten_metric_responses(df).collect()] == [(1704067207000000, 2.0)]


def test_full_nanoseconds_are_not_rounded_up(spark):
    from faultlens.operators.logs import flatten_log_responses
    body = ('{"data":{"result":[{"stream":{"filename":"/var/log/hadoop/hdfs-datanode-cpf-2.log"},"values":'
            '[["1704067200999999999","m"],["x","m"]]}]}}')
    got = flatten_log_responses(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.timestamp, r.timestamp_ns) for r in got] == [("2024-01-01 00:00:00", 1704067200999999999)]


def test_range_join_takes_any_window(spark):
    """NULL, empty, reversed and very long windows; rows outside all windows."""
    from faultlens.operators.rangejoin import range_join
    facts = _samples(spark, [(0, 1.0), (3600, 2.0), (10**6, 3.0)]).union(
        spark.createDataFrame([(9, None, "h", 4.0)], "event_id long, ts timestamp_ntz, host string, v double"))
    far = T0 + dt.timedelta(days=4000)
    rows = [("day", T0, T0 + dt.timedelta(days=1)), ("long", T0 - dt.timedelta(days=9000), far), ("null", None, far),
            ("empty", T0, T0), ("back", far, T0)]
    windows = spark.createDataFrame(rows, "name string, window_start timestamp_ntz, window_end timestamp_ntz")
    got = {(r.name, r.event_id) for r in range_join(facts, windows, "ts").collect()}
    assert got == {("day", 0), ("day", 1), ("long", 0), ("long", 1), ("long", 2)}
    assert range_join(facts, windows.limit(0), "ts").count() == 0
