"""Hot-group stress: one log file holds a third of all rows, packed into one hour.

Compares the bucketed order operators with plain ``Window.partitionBy(file)`` forms on
the same data (results must be identical) and prints one JSON line with timings.
Usage: ``python tools/hot_group_run.py [rows]`` (default 24,000,000).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from faultlens.functions.time import from_epoch_micros
    from faultlens.operators.ordering import running_rank, top_n_per_group, with_previous
    from faultlens.session import build_session

    n = int(sys.argv[1]) if len(sys.argv) > 1 else 24_000_000
    spark = build_session(shuffle_partitions=64)
    base_us = 1_704_067_200_000_000                      # 2024-01-01
    hot = F.col("id") % 3 == 0
    month_us, hour_us = 30 * 86_400 * 1_000_000, 3_600 * 1_000_000
    # deterministic, distinct-ish times: hot rows inside one hour, others over a month
    spread = F.pmod(F.col("id") * F.lit(2_654_435_761), F.lit(month_us))
    packed = F.pmod(F.col("id") * F.lit(2_654_435_761), F.lit(hour_us))
    df = spark.range(0, n, 1, 64).select(
        F.col("id").alias("event_id"),
        F.when(hot, F.lit("/logs/hot.log")).otherwise(F.concat(F.lit("/logs/f"), (F.col("id") % 64).cast("string"))).alias("filename"),
        from_epoch_micros(F.lit(base_us) + F.when(hot, packed).otherwise(spread)).alias("ts"))
    out = {"rows": n, "hot_rows": (n + 2) // 3}

    def timed(name, frame, agg):
        t0 = time.perf_counter()
        val = frame.agg(agg).first()[0]
        out[name + "_s"] = round(time.perf_counter() - t0, 1)
        return val

    w = Window.partitionBy("filename").orderBy("ts", "event_id")
    chk = F.sum(F.col("rank") * F.lit(1.0) + F.col("event_id") % 7)
    plain_rank = timed("rank_plain_window", df.withColumn("rank", F.row_number().over(w)), chk)
    bucketed_rank = timed("rank_bucketed", running_rank(df, ["filename"], "ts", "event_id"), chk)
    prev_chk = F.sum(F.coalesce(F.unix_micros(F.col("p").cast("timestamp")) % 1000, F.lit(0)))
    plain_prev = timed("previous_plain_window", df.withColumn("p", F.lag("ts").over(w)), prev_chk)
    bucketed_prev = timed("previous_bucketed",
                          with_previous(df, ["filename"], "ts", "event_id", []).withColumnRenamed("prev_ts", "p"),
                          prev_chk)
    top_chk = F.sum(F.col("rank") + F.col("event_id") % 7)
    plain_top = timed("top10k_plain_window", df.withColumn("rank", F.row_number().over(w)).where("rank <= 10000"),
                      top_chk)
    bucketed_top = timed("top10k_bucketed", top_n_per_group(df, ["filename"], "ts", "event_id", 10_000), top_chk)
    out["same_results"] = plain_rank == bucketed_rank and plain_prev == bucketed_prev and plain_top == bucketed_top
    print(json.dumps(out))


if __name__ == "__main__":
    main()
