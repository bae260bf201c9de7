"""Streams with state: repeated rows, silence alarms, and run windows joined to logs while both arrive.

All three keep their state in Spark's state store, bounded by a watermark, and resume from their checkpoint after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(rows: DataFrame, ts_col: str, watermark: str, name: str = "_et") -> DataFrame:
    """``rows`` with a watermarked event time (a watermark needs TIMESTAMP; the session's zone is UTC)."""
    return rows.withColumn(name, F.col(ts_col).cast("timestamp")).withWatermark(name, watermark)


def first_collected(records: DataFrame, content: list[str], ts_col: str = "line_ts", delay: str = "1 day") -> DataFrame:
    """Each row once, however often its file is collected again within ``delay`` of event time.

    Rows are told by ``content`` (with the event time among it, a line that is printed again later is another row). State
    holds the keys of the last ``delay``. NULLs in the content are values like others; a row without a time has no place in
    event time and is left out.
    """
    known = timed(records.where(F.col(ts_col).isNotNull()), ts_col, delay)
    return known.dropDuplicatesWithinWatermark(content).drop("_et")


def silence_alarms(samples: DataFrame, group_cols: list[str], ts_col: str, silent: str, watermark: str) -> DataFrame:
    """``(group, first_seen, last_seen, n)``: one row for each time that a group has fallen silent for ``silent``.

    A session of rows closer than ``silent`` ends when the watermark passes its last row by that time; only then is the
    alarm given, so late rows within the watermark still prolong a session. State holds one row for each open session.
    """
    sessions = timed(samples, ts_col, watermark).groupBy(F.session_window("_et", silent).alias("s"), *group_cols).agg(
        F.max(ts_col).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return sessions.select(*group_cols, F.col("s.start").cast("timestamp_ntz").alias("first_seen"), "last_seen", "n")


def windowed_rows(records: DataFrame, windows: DataFrame, keys: list[str], ts_col: str = "line_ts", start_col: str = "window_start",
                  end_col: str = "window_end", bucket: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Rows of one stream inside the windows ``[start, end)`` of another, by equal ``keys``, while both arrive.

    Both sides carry the start of a time bucket as event time (a window one row for each bucket that it overlaps), so
    the join is an equality and the state of a bucket is dropped once the slower stream's watermark has passed it. ``windows``
    must not have columns of ``records`` beside the keys.
    """
    late = watermark
    step = F.expr(f"INTERVAL {bucket}")
    of_row = F.window(F.col(ts_col).cast("timestamp"), bucket).start
    rows = records.select("*", of_row.alias("_bucket")).withWatermark("_bucket", late)
    first = F.window(F.col(start_col).cast("timestamp"), bucket).start
    held = windows.where(F.col(start_col) < F.col(end_col)).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in windows.columns if c not in keys], first.alias("_first"))
    # the last bucket is the one that holds the instant before the end
    held = held.withColumn("_window_bucket", F.explode(F.sequence("_first", F.expr(f"cast({end_col} AS timestamp) - INTERVAL 1 MICROSECOND"), step))) \
        .drop("_first").withWatermark("_window_bucket", late)
    on = F.col("_bucket") == F.col("_window_bucket")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    on = on & (F.col(ts_col) >= F.col(start_col)) & (F.col(ts_col) < F.col(end_col))
    return rows.join(held, on).drop("_bucket", "_window_bucket", *[f"_k{i}" for i in range(len(keys))])
