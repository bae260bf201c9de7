"""As-of join, rolling frames, merged windows and multiset differences against plain versions; hot buckets cut finely."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators.asof import asof_join
from faultlens.operators.intervals import merged_membership, merged_windows
from faultlens.operators.multiset import multiset_diff
from faultlens.operators.rolling import rolling_sums

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def rows_of(n, seed, span=7200):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), None if rnd.random() < 0.05 else rnd.randrange(span), k) for k in range(n)]


LEFT, RIGHT = rows_of(300, 1), rows_of(120, 2)


def nearest(row, direction, tolerance):
    key, t, _ = row
    if key is None or t is None:
        return None
    back = direction == "backward"
    fit = [(s, tie) for k, s, tie in RIGHT if k == key and s is not None and (s <= t if back else s >= t)
           and (tolerance is None or abs(s - t) <= tolerance)]
    return (max if back else min)(fit, default=None)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 90])
@pytest.mark.parametrize("max_rows", [5_000_000, 7])
def test_asof(spark, direction, tolerance, max_rows):
    left = spark.createDataFrame([(k, at(t), i) for k, t, i in LEFT], "k string, t timestamp_ntz, i int")
    right = spark.createDataFrame([(k, at(t), i) for k, t, i in RIGHT], "k string, s timestamp_ntz, tie int")
    got = asof_join(left, right, ["k"], "t", "s", "tie", ["s", "tie"], direction, tolerance, bucket_seconds=600, max_bucket_rows=max_rows)
    assert got.columns == ["k", "t", "i", "s", "tie"]
    want = []
    for row in LEFT:
        found = nearest(row, direction, tolerance)
        want.append((row[2], at(found[0]) if found else None, found[1] if found else None))
    assert sorted((r.i, r.s, r.tie) for r in got.collect()) == sorted(want)


def test_asof_keeps_repeated_rows_and_empty_sides(spark):
    left = spark.createDataFrame([("a", at(5)), ("a", at(5))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 1, "x"), ("a", at(5), 2, "y")], "k string, t timestamp_ntz, tie int, v string")
    assert [r.v for r in asof_join(left, right, ["k"], "t", "t", "tie", ["v"]).collect()] == ["y", "y"]
    assert [r.v for r in asof_join(left, right, ["k"], "t", "t", "tie", ["v"], "forward").collect()] == ["x", "x"]
    assert [r.v for r in asof_join(left, right.limit(0), ["k"], "t", "t", "tie", ["v"]).collect()] == [None, None]
    assert asof_join(left.limit(0), right, ["k"], "t", "t", "tie", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", "t", "tie", ["v"], "sideways")


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_reads_each_row_of_a_bucket_once(spark, direction):
    """A frame that ends with its partition is built anew for each row: time would grow with the square of a bucket."""
    side = spark.range(20).select(F.lit("a").alias("k"), F.lit(T0).cast("timestamp_ntz").alias("t"), F.col("id").alias("i"))
    plan = asof_join(side, side, ["k"], "t", "t", "i", ["i"], direction, prefix="r_")._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("max_rows", [5_000_000, 9])
def test_rolling_sums(spark, max_rows):
    df = spark.createDataFrame([(k, at(t), i) for k, t, i in LEFT], "k string, t timestamp_ntz, i int")
    got = rolling_sums(df, ["k"], "t", 300, {"n": F.lit(1), "odd": F.col("i") % 2}, bucket_seconds=600, max_bucket_rows=max_rows)
    want = set()
    for k, t, _ in LEFT:
        if t is not None:
            frame = [i for k2, t2, i in LEFT if k2 == k and t2 is not None and t - 300 < t2 <= t]
            want.add((str(k), at(t), len(frame), sum(i % 2 for i in frame)))
    rows = [(str(r.k), r.t, r.n, r.odd) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("max_rows", [5_000_000, 5])
def test_merged_windows(spark, max_rows):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), s := rnd.randrange(20_000), s + rnd.choice([0, 5, 60, 60, 900])) for _ in range(150)]
    rows += [("a", 100, None), ("b", None, 100), ("c", 0, 10), ("c", 10, 20), ("c", 21, 22)]
    df = spark.createDataFrame([(g, at(s), at(e)) for g, s, e in rows], "g string, window_start timestamp_ntz, window_end timestamp_ntz")
    members = merged_membership(df, ["g"], bucket_seconds=3600, max_bucket_rows=max_rows)
    got = sorted((r.g, r.merged_start, r.merged_end, r.members) for r in merged_windows(members, ["g"]).collect())
    want = []
    for g, s, e in sorted(r for r in rows if r[1] is not None and r[2] is not None and r[1] < r[2]):
        if want and want[-1][0] == g and s <= want[-1][2]:
            want[-1] = (g, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((g, s, e, 1))
    assert got == [(g, at(s), at(e), n) for g, s, e, n in want]


def test_multiset_diff(spark):
    schema = "a string, b int"
    left = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), (None, None), ("", 2), ("1:x|1", 3)], schema)
    right = spark.createDataFrame([("x", 1), ("y", None), (None, None), (None, 2), ("z", 9), ("z", 9)], schema)
    got = {(r.a, r.b): (r.n_left, r.n_right) for r in multiset_diff(left, right).collect()}
    assert got == {("x", 1): (2, 1), ("", 2): (1, 0), (None, 2): (0, 1), ("1:x|1", 3): (1, 0), ("z", 9): (0, 2)}
    assert multiset_diff(left, left).count() == 0


def test_sql_functions_equal_the_column_functions(spark):
    from faultlens.functions import logs as L
    from faultlens.functions.sqlfuncs import register_sql_functions
    from faultlens.operators.logs import parse_lines
    register_sql_functions(spark)
    paths = ["", None, "x-datanode-cpf-2.log", "secondarynamenode-cpf-1", "application_1_2/cpf-3_45454", "/var/log/syslog"]
    df = spark.createDataFrame([(p,) for p in paths], "f string")
    df.createOrReplaceTempView("paths")
    own = df.select("f", L.node_from_filename(F.col("f")), L.component_from_filename(F.col("f")), L.task_id_from_filename(F.col("f")),
                    L.level_from_message(F.col("f")))
    sql = spark.sql("SELECT f, log_node(f), log_component(f), log_task_id(f), log_level(f) FROM paths")
    assert sorted(map(str, sql.collect())) and [tuple(r) for r in sql.collect()] == [tuple(r) for r in own.collect()]
    lines = ["2024-01-02 03:04:05,678  text x 　", "2024-01-02 03:04:05 y", "2024-01-02 03:04:05", "no time here at all", "", None]
    raw = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "event_id long, line string")
    raw.createOrReplaceTempView("raw_lines")
    sql = spark.sql("SELECT event_id, t.line_ts, t.message FROM raw_lines, LATERAL log_fields(line) AS t ORDER BY event_id")
    want = parse_lines(raw, keep=("event_id",)).select("event_id", "line_ts", "message").orderBy("event_id")
    assert [tuple(r) for r in sql.collect()] == [tuple(r) for r in want.collect()] and sql.count() == 2
    assert "Python" not in sql._jdf.queryExecution().toString()
