"""As-of join: for each row the latest (or next) row of the other side, per key, within a tolerance.

Both sides are put in one sequence per key and cut into time buckets (hot buckets finer, as in :mod:`ordering`), so no task
holds a whole series. Inside a bucket the match is the last right row before a left row; where a bucket has none yet, it is
carried from the nearest earlier bucket with one, from a table of one row per (key, bucket). Looking forward, both go in the
opposite order, so each row of a bucket is read once either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.time import epoch_micros
from faultlens.operators.ordering import (BUCKET, DEFAULT_BUCKET_SECONDS, MAX_BUCKET_ROWS, _adaptive_buckets, join_null_safe,
                                          materialize_sized, maybe_broadcast)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tiebreak: str, columns: list[str],
              direction: str = "backward", tolerance_seconds: float | None = None, prefix: str = "",
              bucket_seconds: int = DEFAULT_BUCKET_SECONDS, max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """``left`` with ``columns`` of the matching ``right`` row (named ``prefix + column``); NULL where there is none.

    ``backward``: the right row of the same keys with the greatest ``right_ts <= left_ts``; ``forward``: with the smallest
    ``right_ts >= left_ts``. Of right rows at one time the one with the greatest ``tiebreak`` counts (forward: the smallest).
    ``tolerance_seconds`` is the greatest distance (inclusive). Left rows with a NULL key or time match nothing and stay;
    right rows with one never match. Every left row gives one row, repeated ones too.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction!r}")
    back = direction == "backward"
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    # at one time the right rows come first when looking back, last when looking forward
    first, last = (0, 1) if back else (1, 0)
    found = F.struct(F.col(right_ts).alias("_at"), F.col(tiebreak).alias("_tie"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    rights = right.where(known & F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).cast("timestamp_ntz").alias("_ts"), F.lit(first).alias("_kind"), found.alias("_right"))
    row = F.struct(*[F.col(c).alias(c) for c in left.columns])
    lefts = left.select(*keys, F.col(left_ts).cast("timestamp_ntz").alias("_ts"), F.lit(last).alias("_kind"), row.alias("_left"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    edge = (F.max if back else F.min)("_right").alias("_edge")
    cut, stats, _ = _adaptive_buckets(both, keys, "_ts", "_kind", bucket_seconds, max_bucket_rows, extra_aggs=[edge])
    # looking forward is looking back in the opposite order: a frame up to the end would be read anew for each row
    ordered = F.asc if back else F.desc
    series = Window.partitionBy(*keys).orderBy(*map(ordered, BUCKET))
    carry = F.last("_edge", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    carried, seen = materialize_sized(stats.withColumn("_carry", carry).select(*keys, *BUCKET, "_carry"))
    inside = Window.partitionBy(*keys, *BUCKET).orderBy(*map(ordered, ("_ts", "_kind", "_right._tie")))
    near = F.last("_right", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    side = maybe_broadcast(carried, rows=seen["rows"], size=seen["bytes"])
    matched = join_null_safe(cut, side, [*keys, *BUCKET]).withColumn("_near", F.coalesce(near, F.col("_carry"))).where(F.col("_kind") == last)
    fits = known & F.col("_ts").isNotNull()
    if tolerance_seconds is not None:
        distance = epoch_micros("_ts") - epoch_micros("_near._at")
        fits = fits & ((distance if back else -distance) <= int(tolerance_seconds * 1_000_000))
    return matched.select("_left.*", *[F.when(fits, F.col(f"_near._v{i}")).alias(prefix + c) for i, c in enumerate(columns)])
