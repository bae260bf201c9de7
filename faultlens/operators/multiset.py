"""What differs between two collections, as multisets: rows with their counts on both sides.

Rows are counted by a digest, so only 32 hex digits and two counts are shuffled for a row; full rows are fetched for the
digests that differ. NULLs equal NULLs, and repeated rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.ordering import materialize_sized, maybe_broadcast


def row_digest(columns: list[str]) -> Column:
    """MD5 of a row: each value behind its length, NULL apart from the empty string."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(columns, n_left, n_right)`` of every distinct row whose counts differ; ``EXCEPT ALL`` both ways at once.

    ``columns`` are the columns to compare (default: those of ``left``); both sides have them with the same types.
    """
    columns = columns or left.columns
    sides = [df.select(*columns).withColumn("_digest", row_digest(columns)) for df in (left, right)]
    marks = [s.select("_digest", F.lit(a).alias("l"), F.lit(b).alias("r")) for s, (a, b) in zip(sides, ((1, 0), (0, 1)))]
    counts = marks[0].unionByName(marks[1]).groupBy("_digest").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    differ, seen = materialize_sized(counts.where(F.col("n_left") != F.col("n_right")))
    small = maybe_broadcast(differ, rows=seen["rows"], size=seen["bytes"])
    # a digest on one side only is fetched from that side; any other from the left one; the first of equal rows stands for all
    rows = sides[0].join(small.where("n_left > 0"), "_digest").unionByName(sides[1].join(small.where("n_left = 0"), "_digest"))
    return rows.groupBy(*columns, "n_left", "n_right").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
