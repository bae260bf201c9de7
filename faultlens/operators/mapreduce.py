"""The batch dataflows: word count, hot-key sum (plain and salted), row multiplication,
explicit shuffle/partition layouts, and the bloat self-check.

The reference runs these as streaming mappers/reducers with no combiner; here each
is one Catalyst plan: ``HashAggregate(partial) -> Exchange -> HashAggregate(final)``,
so a key holding most rows is pre-aggregated on the map side before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.text import hot_cold_key, py_strip, split_runs
from faultlens.operators.ordering import materialize


def tokenize(lines: DataFrame, line_col: str = "line", keep=("doc_id", "line_no")) -> DataFrame:
    """One row per whitespace token of each line; blank lines emit nothing."""
    keep = [c for c in keep if c in lines.columns]
    # a stripped line that isn't blank splits into tokens that aren't empty: no lambda in the generator
    full = lines.select(*keep, py_strip(F.col(line_col)).alias("_text")).where(F.col("_text") != "")
    return full.select(*keep, F.explode(split_runs(F.col("_text"))).alias("word"))


def word_count(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Lines per key (each mapper record counts 1)."""
    return words.groupBy(word_col).agg(F.count(F.lit(1)).alias("n"))


def skew_map(lines: DataFrame, line_col: str = "line", keep=("event_id",)) -> DataFrame:
    """(key, 1) with key ``hot_key`` for lines starting with it, else ``cold_key``."""
    keep = [c for c in keep if c in lines.columns]
    return lines.select(*keep, hot_cold_key(F.col(line_col)).alias("key"), F.lit(1).alias("value"))


def key_sum(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Sum of values per non-empty key (partial aggregation before the shuffle)."""
    return (pairs.where(F.col(key).isNotNull() & (F.col(key) != ""))
            .groupBy(key).agg(F.sum(value).cast("long").alias("total")))


def salted_key_sum(pairs: DataFrame, key: str = "key", value: str = "value",
                   salts: int = 32, *, salt_source: Column) -> DataFrame:
    """Two-phase sum for a key that holds most rows: (key, salt) then key.

    Phase one spreads a hot key over ``salts`` reducers; phase two merges at most
    ``salts`` partial rows per key.  Equal to :func:`key_sum`.  ``salt_source`` is a value of
    the row itself, so a retried task salts its rows alike.
    """
    salt = F.pmod(F.xxhash64(salt_source), F.lit(salts))
    partial = (pairs.where(F.col(key).isNotNull() & (F.col(key) != ""))
               .withColumn("_salt", salt)
               .groupBy(key, "_salt").agg(F.sum(value).alias("_part")))
    return partial.groupBy(key).agg(F.sum("_part").cast("long").alias("total"))


def bloat_expand(lines: DataFrame, copies: int = 4, line_col: str = "line",
                 keep=("doc_id", "line_no")) -> DataFrame:
    """Each stripped line ``copies`` times as ``<line>\\t<i>`` (blank lines included)."""
    keep = [c for c in keep if c in lines.columns]
    return (lines.select(*keep, py_strip(F.col(line_col)).alias("_text"),
                         F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>")).alias("copy"))
            .select(*keep, "copy", F.concat_ws("\t", "_text", F.col("copy").cast("string")).alias("record")))


def bloat_check(raw_lines: DataFrame, map_output: DataFrame, claimed_factor: int = 10) -> DataFrame:
    """One row: raw count, map-output count, threshold ``raw*factor*3/10`` (integer), verdict.

    Both counts are global aggregates (one partial count per task, merged), so no
    data reaches the driver.
    """
    out_count = map_output.agg(F.count(F.lit(1))).scalar()
    raw = raw_lines.agg(F.count(F.lit(1)).alias("raw_lines")).withColumn("map_output_records", out_count)
    expected = F.col("raw_lines") * F.lit(claimed_factor)
    threshold = F.floor(expected * F.lit(3) / F.lit(10)).cast("long")
    return (raw.select("raw_lines", "map_output_records", expected.alias("expected_records"),
                    threshold.alias("threshold"),
                    (F.col("map_output_records") > threshold).alias("bloated"),
                    F.round(F.try_divide(F.col("map_output_records"), F.col("raw_lines")), 6).alias("ratio")))


def first_field(record: Column) -> Column:
    """Streaming key: the text before the first tab."""
    return F.split_part(record, F.lit("\t"), F.lit(1))


def identity_shuffle(records: DataFrame, row_cols: list[str], num_partitions: int | None = None, record_col: str = "record") -> DataFrame:
    """Bring equal keys together, sorted (``-reducer cat``).

    Rows are range-partitioned by (key, ``row_cols``): a key that holds a large share of the rows (blank or repeated
    lines) lies in several neighbouring partitions instead of one task.  ``num_partitions`` defaults to the session's
    shuffle partitions (the reference fixes 8 reducers; at scale the count must follow the data)."""
    keyed = records.withColumn("key", first_field(F.col(record_col)))
    n = num_partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(n, "key", *row_cols).sortWithinPartitions("key", *row_cols)


def partition_of(key: Column, num_partitions: int = 8) -> Column:
    """Partition of a key: the first 28 bits of its MD5, so that any engine deals keys alike."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(num_partitions)).cast("int")


def key_shares(pairs: DataFrame, key: str = "key") -> DataFrame:
    """Skew profile per key: rows, share of all rows, and max/mean of key sizes."""
    # one pass over the pairs; the totals read the materialised per-key table
    per_key = materialize(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = per_key.agg(F.sum("n")).scalar()
    max_over_mean = per_key.agg(F.max("n") / F.avg("n")).scalar()
    return per_key.select(key, "n", F.round(F.col("n") / total, 6).alias("share"),
                          F.round(max_over_mean, 6).alias("max_over_mean"))


def partition_shares(pairs: DataFrame, key: str = "key", num_partitions: int = 8) -> DataFrame:
    """Rows per reducer partition under hash partitioning of ``key``, with shares."""
    per_part = materialize(pairs.groupBy(partition_of(F.col(key), num_partitions).alias("partition"))
                           .agg(F.count(F.lit(1)).alias("n")))
    total = per_part.agg(F.sum("n")).scalar()
    return per_part.select("partition", "n", F.round(F.col("n") / total, 6).alias("share"))
