"""Interval (range) join: rows whose time falls in ``[start, end)`` of a window.

Spark has no interval join strategy; a bare range predicate plans as a nested-loop
join.  Here both sides get an equi-key - the time bucket - so the join is a hash
join: each fact row gets its one bucket, each window is exploded into the buckets
it overlaps, and the exact range predicate is applied after the equi-join.  A
(window, row) pair meets in exactly one bucket, so there are no duplicates.

Windows that span many buckets use wider ones (each level is :data:`WIDER` times the one below), so
no window is exploded into more than about ``MAX_BUCKETS`` rows; a fact row gets one key for each level
that the windows use, which is known from the materialised window side.

The window side is materialised and broadcast only when its measured size is within the
limit; otherwise both sides shuffle on the bucket and AQE splits a hot bucket (skew join).
The earliest start and the latest end are observed in the same job and bound the facts
as literals, so files and row groups outside are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.time import time_bucket
from faultlens.operators.ordering import BROADCAST_ROW_LIMIT, materialize_sized, maybe_broadcast

MAX_BUCKETS = 64
WIDER = 32
LEVELS = 6


def range_join(facts: DataFrame, windows: DataFrame, ts_col: str, start_col: str = "window_start",
               end_col: str = "window_end", bucket_seconds: int = 3600,
               broadcast_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Pairs of a fact and a window that holds its time; empty and NULL windows hold nothing.

    The window side is exploded into its buckets and checkpointed once (its size and bounds are
    observed in the same job), so a window table reused by several joins is built once."""
    own = windows.where(F.col(start_col) < F.col(end_col))
    seconds = F.unix_micros(F.col(end_col).cast("timestamp")) - F.unix_micros(F.col(start_col).cast("timestamp"))
    widths = [bucket_seconds * WIDER**k for k in range(LEVELS)]
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(seconds <= F.lit(widths[k] * MAX_BUCKETS * 1_000_000), F.lit(k)).otherwise(level)

    def bucket(col: str, chosen):
        return F.element_at(F.array(*[time_bucket(F.col(col), w) for w in widths]), chosen + 1)

    exploded = own.withColumn("_level", level).withColumn("_b", F.explode(F.sequence(
        bucket(start_col, F.col("_level")), bucket(end_col, F.col("_level")))))
    exploded, seen = materialize_sized(exploded, first=F.min(start_col), last=F.max(end_col), levels=F.sort_array(F.collect_set("_level")))
    side = maybe_broadcast(exploded, broadcast_rows, rows=seen["rows"], size=seen["bytes"])
    bounded = facts.where((F.col(ts_col) >= F.lit(seen["first"]).cast("timestamp_ntz"))
                          & (F.col(ts_col) < F.lit(seen["last"]).cast("timestamp_ntz")))
    keys = [F.struct(F.lit(k).alias("_level"), time_bucket(F.col(ts_col), widths[k]).alias("_b")) for k in seen["levels"] or [0]]
    keyed = bounded.withColumn("_k", F.explode(F.array(*keys)) if len(keys) > 1 else keys[0]).select("*", "_k.*").drop("_k")
    return (keyed.join(side, ["_level", "_b"], "inner")
            .where((F.col(ts_col) >= F.col(start_col)) & (F.col(ts_col) < F.col(end_col)))
            .drop("_level", "_b"))
