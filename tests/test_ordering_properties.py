"""Property test: bucketed order operators equal plain windows on arbitrary small inputs.

Covers duplicate timestamps (tiebreak decides), times before 1970, tiny bucket widths and
row limits that force refinement down to single instants.
"""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultlens.operators.ordering import running_rank, top_n_per_group, with_previous

BASE = dt.datetime(1969, 12, 31, 22, 0, 0)

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(min_value=0, max_value=4 * 3600 * 1_000_000)),
    min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, bucket_seconds=st.sampled_from([60, 3600, 86400]),
       max_rows=st.integers(min_value=1, max_value=12), n=st.integers(min_value=1, max_value=10),
       coarse_times=st.booleans())
def test_bucketed_equals_plain(spark, rows, bucket_seconds, max_rows, n, coarse_times):
    data = [(i, g, BASE + dt.timedelta(microseconds=(us // 600_000_000) * 600_000_000 if coarse_times else us))
            for i, (g, us) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, ts timestamp_ntz")
    w = Window.partitionBy("g").orderBy("ts", "id")
    plain = df.select("id", F.row_number().over(w).alias("rk"), F.lag("ts").over(w).alias("p")).collect()
    rank = {r.id: r.rk for r in plain}
    prev = {r.id: r.p for r in plain}
    kw = dict(bucket_seconds=bucket_seconds, max_bucket_rows=max_rows)
    assert {r.id: r.rank for r in running_rank(df, ["g"], "ts", "id", **kw).collect()} == rank
    assert {r.id: r.rank for r in top_n_per_group(df, ["g"], "ts", "id", n, **kw).collect()} == \
        {i: k for i, k in rank.items() if k <= n}
    assert {r.id: r.prev_ts for r in with_previous(df, ["g"], "ts", "id", [], **kw).collect()} == prev
