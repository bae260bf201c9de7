"""Task skew of a hot file, plain window vs bucketed rank, measured from the event log.

``python tools/hot_group_skew.py [rows]`` (default 12,000,000; a third of the rows are one file
inside one hour).  Prints one JSON line: for each form, the slowest stage's wall time, its task
count, and its longest task over the median task (1.0 = balanced).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from faultlens.functions.time import from_epoch_micros
    from faultlens.operators.ordering import running_rank
    from faultlens.session import build_session
    from tools.stage_times import stage_summary

    n = int(sys.argv[1]) if len(sys.argv) > 1 else 12_000_000
    results = {}
    for form in ("plain_window", "bucketed"):
        log_dir = tempfile.mkdtemp(prefix="faultlens-skew-")
        spark = build_session(shuffle_partitions=64, extra={
            "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"})
        hot = F.col("id") % 3 == 0
        scatter = F.col("id") * F.lit(2_654_435_761)
        df = spark.range(0, n, 1, 64).select(
            F.col("id").alias("event_id"),
            F.when(hot, F.lit("/logs/hot.log"))
             .otherwise(F.concat(F.lit("/logs/f"), (F.col("id") % 64).cast("string"))).alias("filename"),
            from_epoch_micros(F.lit(1_704_067_200_000_000)
                              + F.when(hot, F.pmod(scatter, F.lit(3_600_000_000)))
                              .otherwise(F.pmod(scatter, F.lit(30 * 86_400_000_000)))).alias("ts"))
        if form == "plain_window":
            out = df.withColumn("rank", F.row_number().over(Window.partitionBy("filename").orderBy("ts", "event_id")))
        else:
            out = running_rank(df, ["filename"], "ts", "event_id", max_bucket_rows=1_000_000)
        out.write.format("noop").mode("overwrite").save()
        spark.stop()
        slowest = max(stage_summary(log_dir), key=lambda r: r["wall_ms"])
        results[form] = {"slowest_stage_ms": slowest["wall_ms"], "tasks": slowest["tasks"],
                         "max_over_median_task": slowest["max_over_median_task"]}
    print(json.dumps({"rows": n, **results}))


if __name__ == "__main__":
    main()
