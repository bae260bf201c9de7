"""Rolling time frames by prefix sums: how much fell into the last so many seconds, at every instant of a group.

Rows of one instant are added up first. Running totals come from bucket totals and a running sum inside each bucket; what
lies before the frame is the running total as of ``seconds`` earlier, found by the as-of join. Nothing is copied into
neighbouring buckets, however long the frame, and a hot group or bucket is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.asof import asof_join
from faultlens.operators.ordering import (BUCKET, DEFAULT_BUCKET_SECONDS, MAX_BUCKET_ROWS, _adaptive_buckets, join_null_safe,
                                          materialize, materialize_sized, maybe_broadcast)


def running_totals(df: DataFrame, group_cols: list[str], ts_col: str, measures: list[str], bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                   max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """``df`` with ``run_<m>``: the sum of each measure over the group's rows up to this time.

    ``df`` has one row for each group and time.
    """
    one = df.withColumn("_one", F.lit(0))
    totals = [F.sum(m).alias(f"_sum_{m}") for m in measures]
    cut, stats, _ = _adaptive_buckets(one, group_cols, ts_col, "_one", bucket_seconds, max_bucket_rows, extra_aggs=totals)
    before = Window.partitionBy(*group_cols).orderBy(*BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets, seen = materialize_sized(stats.select(
        *group_cols, *BUCKET, *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures]))
    inside = Window.partitionBy(*group_cols, *BUCKET).orderBy(ts_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_null_safe(cut, maybe_broadcast(offsets, rows=seen["rows"], size=seen["bytes"]), [*group_cols, *BUCKET])
    return joined.select(*df.columns, *[(F.col(f"_before_{m}") + F.sum(m).over(inside)).alias(f"run_{m}") for m in measures])


def rolling_sums(df: DataFrame, group_cols: list[str], ts_col: str, seconds: int, measures: dict[str, Column],
                 bucket_seconds: int = DEFAULT_BUCKET_SECONDS, max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """``(group, ts, <measures>)``: for every instant of a group the sums over ``(ts - seconds, ts]``.

    ``measures`` maps names to whole-number columns (1 counts rows), so differences of running totals are exact. Rows
    without a time are in no frame; NULL groups are a group of their own; NULL values add nothing.
    """
    names = list(measures)
    marks = [f"_null{i}" for i in range(len(group_cols))]
    at = (df.where(F.col(ts_col).isNotNull()).groupBy(*group_cols, ts_col)
          .agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in measures.items()]))
    totals = materialize(running_totals(at, group_cols, ts_col, names, bucket_seconds, max_bucket_rows))
    # the as-of join matches known keys only: a NULL group is told by a mark beside a stand-in
    keyed = totals.select("*", *[F.struct(F.col(g).isNull().alias("n"), F.col(g).alias("v")).alias(m) for g, m in zip(group_cols, marks)])
    earlier = keyed.select(*marks, F.timestamp_add("SECOND", F.lit(seconds), F.col(ts_col)).alias("_leaves"), F.lit(0).alias("_tie"),
                           *[F.col(f"run_{n}").alias(f"_gone_{n}") for n in names])
    joined = asof_join(keyed, earlier, marks, ts_col, "_leaves", "_tie", [f"_gone_{n}" for n in names],
                       bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows)
    return joined.select(*group_cols, ts_col, *[(F.col(f"run_{n}") - F.coalesce(f"_gone_{n}", F.lit(0))).alias(n) for n in names])
