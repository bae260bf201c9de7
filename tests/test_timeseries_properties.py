"""Property test: grid fan-out time-series operators equal a direct per-grid-point evaluation."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultlens.operators import metrics as M

T0 = dt.datetime(2024, 1, 1)
STEP, LOOKBACK, RANGE = 60, 150, 120
START, END = "2024-01-01 00:01:00", "2024-01-01 00:10:00"


def _grid():
    t = T0 + dt.timedelta(minutes=1)
    while t <= T0 + dt.timedelta(minutes=10):
        yield t
        t += dt.timedelta(seconds=STEP)


def _brute(samples):
    """samples: sorted list of (ts, id, value) for one series."""
    instant, inc, rate = {}, {}, {}
    for t in _grid():
        look = [s for s in samples if t - dt.timedelta(seconds=LOOKBACK) < s[0] <= t]
        if look:
            instant[t] = max(look)[2]
        win = [s for s in samples if t - dt.timedelta(seconds=RANGE) < s[0] <= t]
        if len(win) >= 2:
            total = win[-1][2] - win[0][2] + sum(a[2] for a, b in zip(win, win[1:]) if b[2] < a[2])
            inc[t] = total
            sampled = (win[-1][0] - win[0][0]).total_seconds()
            avg = sampled / (len(win) - 1)
            to_start = (win[0][0] - (t - dt.timedelta(seconds=RANGE))).total_seconds()
            to_end = (t - win[-1][0]).total_seconds()
            if total > 0 and win[0][2] >= 0:
                to_start = min(to_start, sampled * (win[0][2] / total))
            ext = sampled + (to_start if to_start < avg * 1.1 else avg / 2) + (to_end if to_end < avg * 1.1 else avg / 2)
            rate[t] = total * (ext / sampled) / RANGE
    return instant, inc, rate


points = st.lists(st.tuples(st.integers(min_value=0, max_value=660), st.integers(min_value=0, max_value=50)),
                  min_size=1, max_size=25, unique_by=lambda p: p[0])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pts=points)
def test_grid_operators_equal_brute_force(spark, pts):
    samples = sorted((T0 + dt.timedelta(seconds=s), i, float(v)) for i, (s, v) in enumerate(pts))
    df = spark.createDataFrame([(i, ts, "h", v) for ts, i, v in samples],
                               "event_id long, ts timestamp_ntz, host string, v double")
    want_instant, want_inc, want_rate = _brute(samples)
    got_instant = {r.t: r.value for r in M.instant_values(df, ["host"], "v", START, END, STEP, LOOKBACK).collect()}
    got_inc = {r.t: r.increase for r in M.counter_increase(df, ["host"], "v", START, END, STEP, RANGE).collect()}
    got_rate = {r.t: r.rate for r in M.counter_rate(df, ["host"], "v", START, END, STEP, RANGE).collect()}
    assert got_instant == want_instant
    assert got_inc == pytest.approx(want_inc)
    assert got_rate.keys() == want_rate.keys()
    for t in want_rate:
        assert got_rate[t] == pytest.approx(want_rate[t])
