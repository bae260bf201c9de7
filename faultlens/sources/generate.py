"""Synthetic job inputs: the skewed two-key file and the unique-key bloat file.

Generation is ``spark.range`` over many partitions (no driver-side data); only the
row count is computed on the driver, from the target size, by arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import mapreduce as mr
from faultlens.operators.ordering import materialize

# --- fixed values (the reference's generator parameters) -------------------------
HOT_KEY, COLD_KEY = "hot_key", "cold_key"
SKEW_HOT_PER_BATCH = 618_750          # int(5e6 * 0.99 / len("hot_key\n"))
SKEW_COLD_PER_BATCH = 5_555           # int(5e6 * 0.01 / len("cold_key\n"))
BLOAT_PER_BATCH = 52_631              # 5e6 // len(base line)
BLOAT_KEY_PREFIX = "bloat_key_"
BLOAT_TEXT = "VeryLargeExpandedValueABCDEFGHIJKLMNOPQRSTUVWXZY12345678900987654321ZYXWVUTSRQPONMLKJIHGFEDCBA"
REFERENCE_TARGET_BYTES = 3_200_000_000
# -------------------------------------------------------------------------------

ROWS_PER_PARTITION = 2_000_000
MAX_PARTITIONS = 100_000      # at 100 TB-scale targets, bigger partitions rather than millions of tasks


def _partitions(rows: int) -> int:
    """Generated rows stream through each task (nothing is held), so only the task count is capped."""
    return max(1, min(MAX_PARTITIONS, math.ceil(rows / ROWS_PER_PARTITION)))


def corpus_bytes(documents: DataFrame, text_col: str = "text") -> int:
    """Size target taken from data: total characters of a text column (one scalar)."""
    v = documents.agg(F.sum(F.length(text_col))).first()[0]
    return int(v or 0)


def skew_batches(target_bytes: int, hot: int = SKEW_HOT_PER_BATCH, cold: int = SKEW_COLD_PER_BATCH) -> int:
    """Whole batches written until the byte size reaches the target."""
    batch_bytes = hot * (len(HOT_KEY) + 1) + cold * (len(COLD_KEY) + 1)
    return max(0, math.ceil(target_bytes / batch_bytes))


def skew_lines(spark: SparkSession, target_bytes: int = REFERENCE_TARGET_BYTES,
               hot: int = SKEW_HOT_PER_BATCH, cold: int = SKEW_COLD_PER_BATCH) -> DataFrame:
    """Batches of ``hot`` hot-key lines then ``cold`` cold-key lines until the size is reached."""
    per_batch = hot + cold
    rows = skew_batches(target_bytes, hot, cold) * per_batch
    ids = spark.range(0, rows, 1, _partitions(rows))
    line = F.when(F.col("id") % per_batch < hot, F.lit(HOT_KEY)).otherwise(F.lit(COLD_KEY))
    return ids.select(F.col("id").alias("line_id"), line.alias("line"))


def _digit_total(rows: int) -> int:
    """Total decimal digits of 0..rows-1."""
    total, lo, d = 0, 0, 1
    while lo < rows:
        hi = min(rows, 10 ** d)
        total += (hi - lo) * d
        lo, d = hi, d + 1
    return total


def bloat_line_bytes(rows: int) -> int:
    """Bytes of the first ``rows`` bloat lines, newlines included."""
    fixed = len(BLOAT_KEY_PREFIX) + 1 + len(BLOAT_TEXT) + 1   # prefix, tab, text, newline
    return rows * fixed + _digit_total(rows)


def bloat_rows(target_bytes: int, per_batch: int = BLOAT_PER_BATCH) -> int:
    """Rows written by whole batches until the byte size reaches the target (binary search)."""
    if target_bytes <= 0:
        return 0
    lo, hi = 1, 1
    while bloat_line_bytes(hi * per_batch) < target_bytes:
        hi *= 2
    while lo < hi:
        mid = (lo + hi) // 2
        if bloat_line_bytes(mid * per_batch) >= target_bytes:
            hi = mid
        else:
            lo = mid + 1
    return lo * per_batch


def bloat_lines(spark: SparkSession, target_bytes: int = REFERENCE_TARGET_BYTES,
                per_batch: int = BLOAT_PER_BATCH) -> DataFrame:
    """Unique-key bloat lines ``bloat_key_<n><TAB><text>`` up to the target size."""
    rows = bloat_rows(target_bytes, per_batch)
    ids = spark.range(0, rows, 1, _partitions(rows))
    line = F.concat(F.lit(BLOAT_KEY_PREFIX), F.col("id").cast("string"), F.lit("\t" + BLOAT_TEXT))
    return ids.select(F.col("id").alias("line_id"), line.alias("line"))


def summarise_skew(lines: DataFrame) -> DataFrame:
    """The skew job over generated lines: (key, total, share)."""
    sums = materialize(mr.key_sum(mr.skew_map(lines, keep=())))
    total = sums.agg(F.sum("total")).scalar()
    return sums.select("key", "total", F.round(F.col("total") / total, 6).alias("share"))


def summarise_bloat(lines: DataFrame) -> DataFrame:
    """The bloat job over generated lines: x4 map output and its self-check, plus input bytes."""
    expanded = mr.bloat_expand(lines, copies=4, keep=())
    in_bytes = lines.agg(F.sum(F.length("line") + F.lit(1))).scalar()
    return mr.bloat_check(lines, expanded).withColumn("input_bytes", in_bytes.cast("long"))


SKEW_SUMMARY_SQL = f"""
WITH t AS (SELECT CAST(ceil(sum(length(text)) / {SKEW_HOT_PER_BATCH * 8 + SKEW_COLD_PER_BATCH * 9}.0) AS BIGINT) AS nb
           FROM documents),
g AS (SELECT CASE WHEN i % {SKEW_HOT_PER_BATCH + SKEW_COLD_PER_BATCH} < {SKEW_HOT_PER_BATCH}
                  THEN 'hot_key' ELSE 'cold_key' END AS key
      FROM range(0, (SELECT nb * {SKEW_HOT_PER_BATCH + SKEW_COLD_PER_BATCH} FROM t)) AS r(i)),
s AS (SELECT key, CAST(count(*) AS BIGINT) AS total FROM g GROUP BY key)
SELECT key, total, round(total / (SELECT sum(total) FROM s), 6) AS share FROM s
"""

_FIXED = len(BLOAT_KEY_PREFIX) + 1 + len(BLOAT_TEXT) + 1
BLOAT_SUMMARY_SQL = f"""
WITH t AS (SELECT sum(length(text)) AS target FROM documents),
k AS (SELECT range AS k FROM range(1, (SELECT CAST(ceil(target / ({BLOAT_PER_BATCH} * {_FIXED + 1}.0)) AS BIGINT) + 2 FROM t))),
b AS (SELECT k * {BLOAT_PER_BATCH} AS r,
             k * {BLOAT_PER_BATCH} * {_FIXED} + (SELECT sum(d * greatest(0, least(k * {BLOAT_PER_BATCH}, CAST(10 ** d AS BIGINT))
                                                   - CASE WHEN d = 1 THEN 0 ELSE CAST(10 ** (d - 1) AS BIGINT) END))
                                          FROM range(1, 19) AS dd(d)) AS bytes
      FROM k),
n AS (SELECT min(r) AS rows FROM b, t WHERE bytes >= target),
g AS (SELECT '{BLOAT_KEY_PREFIX}' || i || chr(9) || '{BLOAT_TEXT}' AS line FROM range(0, (SELECT rows FROM n)) AS r(i))
SELECT raw_lines, map_output_records, raw_lines * 10 AS expected_records,
       CAST(floor(raw_lines * 10 * 3 / 10) AS BIGINT) AS threshold,
       map_output_records > CAST(floor(raw_lines * 10 * 3 / 10) AS BIGINT) AS bloated,
       round(map_output_records / raw_lines, 6) AS ratio, input_bytes
FROM (SELECT count(*) AS raw_lines, count(*) * 4 AS map_output_records,
             CAST(sum(length(line) + 1) AS BIGINT) AS input_bytes FROM g)
"""
