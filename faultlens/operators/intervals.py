"""Interval coalescing: overlapping or touching windows become one, and each window knows the one it is part of.

The sweep goes over windows in order of their start: a window begins a new merged one if it starts after every end before
it. The greatest end so far comes from a running maximum inside a time bucket and one over the buckets before, so a group
with very many windows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.asof import asof_join
from faultlens.operators.ordering import (BUCKET, DEFAULT_BUCKET_SECONDS, MAX_BUCKET_ROWS, _adaptive_buckets, join_null_safe,
                                          materialize, materialize_sized, maybe_broadcast)


def merged_membership(windows: DataFrame, group_cols: list[str], start_col: str = "window_start", end_col: str = "window_end",
                      bucket_seconds: int = 24 * DEFAULT_BUCKET_SECONDS, max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """``windows`` with ``merged_start``: the start of the merged window that holds it.

    Windows are half-open; ones that touch are merged. Empty windows (end not after start) and ones with a NULL bound or
    group are left out. ``group_cols`` may be empty.
    """
    own = windows.where(F.col(start_col) < F.col(end_col))
    for g in group_cols:
        own = own.where(F.col(g).isNotNull())
    own = own.withColumns({"_all": F.lit(0), "_one": F.lit(0)})
    keys = [*group_cols, "_all"]
    # windows of one start are one step of the sweep: the longest
    starts = own.groupBy(*keys, "_one", start_col).agg(F.max(end_col).alias(end_col))
    cut, stats, _ = _adaptive_buckets(starts, keys, start_col, "_one", bucket_seconds, max_bucket_rows,
                                      extra_aggs=[F.max(end_col).alias("_end")])
    earlier = Window.partitionBy(*keys).orderBy(*BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    reach, seen = materialize_sized(stats.select(*keys, *BUCKET, F.max("_end").over(earlier).alias("_reach")))
    inside = Window.partitionBy(*keys, *BUCKET).orderBy(start_col).rowsBetween(Window.unboundedPreceding, -1)
    swept = join_null_safe(cut, maybe_broadcast(reach, rows=seen["rows"], size=seen["bytes"]), [*keys, *BUCKET]).withColumn(
        "_before", F.greatest(F.max(end_col).over(inside), F.col("_reach")))
    new = materialize(swept.where(F.col("_before").isNull() | (F.col(start_col) > F.col("_before")))
                      .select(*keys, F.col(start_col).alias("merged_start"), "_one"))
    return asof_join(own, new, keys, start_col, "merged_start", "_one", ["merged_start"], bucket_seconds=bucket_seconds,
                     max_bucket_rows=max_bucket_rows).drop("_all", "_one")


def merged_windows(members: DataFrame, group_cols: list[str], end_col: str = "window_end") -> DataFrame:
    """``(group, merged_start, merged_end, members)`` of what :func:`merged_membership` gives."""
    return members.groupBy(*group_cols, "merged_start").agg(F.max(end_col).alias("merged_end"), F.count(F.lit(1)).alias("members"))
