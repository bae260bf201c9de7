"""Streaming versions of log tagging (R6) and per-window counts (R7).

Sources are file streams (new files in a landing folder); sinks are parquet folders
with checkpoints in the session's shared folder, so a restarted or failed query
resumes exactly where it stopped.  ``run_available_now`` drains what has landed and
stops (batch-like scheduling with streaming state and exactly-once sinks).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultlens.operators import logs as L
from faultlens.sources.fixtures import raw_log_from

#: Seconds between two looks at a running query's progress.
POLL_S = 1

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """File-stream source over landed event files (new files become micro-batches)."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def tag_stream(raw_lines: DataFrame) -> DataFrame:
    """Stateless: the batch parser applied to each micro-batch."""
    return L.parse_lines(raw_lines)


def window_counts(records: DataFrame, ts_col: str, keys: list[str], window: str, watermark: str) -> DataFrame:
    """Rows per (tumbling window, keys); a window is emitted once the watermark passes its end.

    The watermark needs a TIMESTAMP (not TIMESTAMP_NTZ) column, so event time is cast;
    with the session in UTC the wall-clock values are unchanged.
    """
    timed = records.withColumn("_et", F.col(ts_col).cast("timestamp"))
    counts = (timed.withWatermark("_et", watermark)
              .groupBy(F.window("_et", window).alias("w"), *keys)
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                         F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "n")


@dataclass(frozen=True)
class Drained:
    """What one run over the landed input did."""

    path: str
    input_rows: int
    #: Rows later than the watermark, which a windowed count leaves out.
    late_rows: int


def _drain(q: StreamingQuery, path: str, timeout_s: float | None) -> Drained:
    """Wait for the end of a query (without a limit by default) and sum up its micro-batches."""
    batches, waited = {}, 0.0
    while True:
        done = q.awaitTermination(POLL_S)
        for p in q.recentProgress:
            batches[p["batchId"]] = (p["numInputRows"], sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"]))
        if done or not q.isActive:
            break
        waited += POLL_S
        if timeout_s is not None and waited >= timeout_s:
            q.stop()
            raise TimeoutError(f"stream did not drain within {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()
    return Drained(path, sum(b[0] for b in batches.values()), sum(b[1] for b in batches.values()))


def run_available_now(df: DataFrame, sink_path: str, checkpoint_path: str, output_mode: str = "append",
                      timeout_s: float | None = None) -> Drained:
    """Drain the landed input into a parquet sink and stop; says how many late rows were left out."""
    q = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start(sink_path))
    return _drain(q, sink_path, timeout_s)


def stream_raw_log(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming raw log lines (the batch projection applied to the event stream)."""
    return raw_log_from(event_stream(spark, folder))


def stream_to_csv_layout(records: DataFrame, root: str, checkpoint_path: str, timeout_s: float | None = None) -> str:
    """Tagged log records from a stream into the per-node CSV layout, one folder per micro-batch.

    ``foreachBatch`` overwrites ``<root>/epoch=<id>`` for each batch, so a retried batch
    replaces its own output: together with the checkpoint this is exactly-once.
    """
    from faultlens.plans.collect import write_logs

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        source = F.when(F.col("task_id").isNotNull(), F.lit("task")).otherwise(F.lit("component"))
        write_logs(batch.withColumn("source", source), f"{root}/epoch={epoch_id}")

    q = (records.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    return _drain(q, root, timeout_s).path
