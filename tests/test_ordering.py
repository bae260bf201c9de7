"""Bucketed order operators equal the plain window forms, with one group holding most rows."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultlens.operators.ordering import global_order_number, running_rank, top_n_per_group, with_previous


def _data(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 10 else f"g{i % 7}", base + dt.timedelta(seconds=(i * 7919) % 200000)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, ts timestamp_ntz")


def test_top_n_and_rank(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    ref = {(r.id, r.rk) for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    top = {(r.id, r.rank) for r in top_n_per_group(df, ["g"], "ts", "id", 25, bucket_seconds=3600).collect()}
    assert top == {x for x in ref if x[1] <= 25}
    rk = {(r.id, r.rank) for r in running_rank(df, ["g"], "ts", "id", bucket_seconds=3600).collect()}
    assert rk == ref


def test_with_previous(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    ref = {(r.id, r.p) for r in df.select("id", F.lag("ts").over(w).alias("p")).collect()}
    got = {(r.id, r.prev_ts) for r in with_previous(df, ["g"], "ts", "id", [], bucket_seconds=1800).collect()}
    assert got == ref


def test_null_groups_and_times_stay(spark):
    """Equal to plain windows on rows with a NULL group, a NULL time or both, also with refined buckets."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 5 == 0 else f"g{i % 2}", None if i % 7 == 0 else base + dt.timedelta(seconds=(i * 37) % 9000))
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp_ntz")
    w = Window.partitionBy("g").orderBy("ts", "id")
    ref = {(r.id, r.rk, r.p) for r in df.select("id", F.row_number().over(w).alias("rk"), F.lag("id").over(w).alias("p")).collect()}
    for limit in (5, 10**6):
        rank = running_rank(df, ["g"], "ts", "id", bucket_seconds=3600, max_bucket_rows=limit).collect()
        assert {(r.id, r.rank) for r in rank} == {x[:2] for x in ref}
        top = top_n_per_group(df, ["g"], "ts", "id", 9, bucket_seconds=3600, max_bucket_rows=limit).collect()
        assert {(r.id, r.rank) for r in top} == {x[:2] for x in ref if x[1] <= 9}
        prev = with_previous(df, ["g"], "ts", "id", ["id"], bucket_seconds=3600, max_bucket_rows=limit).collect()
        assert {(r.id, r.prev_id) for r in prev} == {(x[0], x[2]) for x in ref}


def test_only_hot_buckets_are_counted_again(spark):
    from faultlens.operators.ordering import _adaptive_buckets
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "g", base + dt.timedelta(hours=i % 3, seconds=i if i % 3 == 0 else 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp_ntz")
    _, stats, seen = _adaptive_buckets(df, ["g"], "ts", "id", 3600, 100)
    counts = [r._cnt for r in stats.collect()]
    assert sum(counts) == 300 and seen["rows"] == len(counts)
    _, stats, _ = _adaptive_buckets(df, ["g"], "ts", "id", 3600, 40)
    assert sum(r._cnt for r in stats.collect()) == 300


def test_one_instant_and_null_times_are_cut_by_the_tiebreak(spark):
    from faultlens.operators.ordering import _adaptive_buckets
    base = dt.datetime(2024, 1, 1)
    rows = [(i * i - 5000, "g", None if i % 3 == 0 else base) for i in range(400)] + [(None, "g", base), (None, "h", None)]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp_ntz")
    _, stats, _ = _adaptive_buckets(df, ["g"], "ts", "id", 3600, 20)
    counts = [r._cnt for r in stats.collect()]
    assert sum(counts) == 402 and max(counts) <= 21
    w = Window.partitionBy("g").orderBy("ts", "id")
    ref = {(r.g, r.id, r.rk, r.p) for r in df.select("g", "id", F.row_number().over(w).alias("rk"), F.lag("id").over(w).alias("p")).collect()}
    rank = running_rank(df, ["g"], "ts", "id", bucket_seconds=3600, max_bucket_rows=20).collect()
    assert {(r.g, r.id, r.rank) for r in rank} == {x[:3] for x in ref}
    prev = with_previous(df, ["g"], "ts", "id", ["id"], bucket_seconds=3600, max_bucket_rows=20).collect()
    assert {(r.g, r.id, r.prev_id) for r in prev} == {(x[0], x[1], x[3]) for x in ref}
    top = top_n_per_group(df, ["g"], "ts", "id", 33, bucket_seconds=3600, max_bucket_rows=20).collect()
    assert {(r.g, r.id, r.rank) for r in top} == {x[:3] for x in ref if x[2] <= 33}


def test_global_order_number(spark):
    df = _data(spark)
    got = global_order_number(df, ["ts", "id"], num_partitions=5).select("id", "k").collect()
    ref = df.select("id", F.row_number().over(Window.orderBy("ts", "id")).alias("k")).collect()
    assert {(r.id, r.k) for r in got} == {(r.id, r.k) for r in ref}


def test_exact_median_matches_percentile(spark):
    from faultlens.operators.ordering import exact_median
    for n in (1, 2, 7, 10):
        df = spark.range(n).select(F.col("id"), ((F.col("id") * 37) % 11).cast("double").alias("x"))
        want = df.agg(F.percentile("x", 0.5)).first()[0]
        got = spark.range(1).select(exact_median(df, "x", ["id"]).alias("m")).first().m
        assert got == want


def test_maybe_broadcast_checks_rows_and_bytes(spark):
    from faultlens.operators.ordering import BROADCAST_BYTES_KEY, materialize, maybe_broadcast
    small = materialize(spark.range(100).withColumn("s", F.lit("x")))
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(maybe_broadcast(small)).lower()
    assert "broadcast" not in plan(maybe_broadcast(small, row_limit=10)).lower()
    spark.conf.set(BROADCAST_BYTES_KEY, "100")
    try:
        assert "broadcast" not in plan(maybe_broadcast(small)).lower()
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


def test_shuffle_path_when_broadcast_refused(spark):
    """Beyond the broadcast budget the joins shuffle; results must not change."""
    from faultlens.operators.ordering import BROADCAST_BYTES_KEY
    from faultlens.plans.catalog import QUERIES, load_all
    from tests.harness import rows_of_spark
    load_all()
    sf = "/root/testdata/sf0.001"
    names = ["task_window_logs", "log_topn_per_file", "log_sorted_rank", "metric_rate", "silence_gaps"]
    want = {n: rows_of_spark(QUERIES[n](spark, sf)) for n in names}
    spark.conf.set(BROADCAST_BYTES_KEY, "1")
    try:
        for n in names:
            df = QUERIES[n](spark, sf)
            plan = df._jdf.queryExecution().logical().toString().lower()
            assert "broadcast" not in plan, n
            assert rows_of_spark(df) == want[n], n
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


def test_hot_bucket_is_refined(spark):
    """One hour of one group holds most rows: buckets are cut finer, results unchanged."""
    from faultlens.operators.ordering import _adaptive_buckets
    base = dt.datetime(2024, 1, 1, 5)
    rows = [(i, "hot", base + dt.timedelta(microseconds=(i * 7919) % 3_000_000_000)) for i in range(2000)]
    rows += [(10_000 + i, "cold", base + dt.timedelta(hours=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp_ntz")
    b, st, _ = _adaptive_buckets(df, ["g"], "ts", "id", 3600, max_bucket_rows=100)
    assert st.agg(F.max("_cnt")).first()[0] <= 100 and st.count() > 20
    w = Window.partitionBy("g").orderBy("ts", "id")
    ref_rank = {(r.id, r.rk) for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    ref_prev = {(r.id, r.p) for r in df.select("id", F.lag("ts").over(w).alias("p")).collect()}
    assert {(r.id, r.rank) for r in running_rank(df, ["g"], "ts", "id", max_bucket_rows=100).collect()} == ref_rank
    assert {(r.id, r.rank) for r in top_n_per_group(df, ["g"], "ts", "id", 150, max_bucket_rows=100).collect()} \
        == {x for x in ref_rank if x[1] <= 150}
    assert {(r.id, r.prev_ts) for r in with_previous(df, ["g"], "ts", "id", [], max_bucket_rows=100).collect()} \
        == ref_prev
