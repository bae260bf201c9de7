"""Connected components of a link table by alternating large-star and small-star steps.

The links stay distributed; every round is settled in the shared folder, so a
lost executor repeats at most one round.  The smallest neighbours are settled before they are joined:
both sides of a join are then plain exchanges, and Spark can split a vertex with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import settle


def _mark(links: DataFrame) -> tuple:
    """Row count and order-free fingerprint of a link table."""
    row = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long vertices -> ``(vertex, root)`` for every vertex that has a link to another one.

    ``root`` is the smallest vertex of the component and is not listed itself.
    Null ends and self links are ignored, repeated links count once, an empty
    table gives an empty table.
    """
    now = settle(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = settle(large)
        lowest = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now, before = settle(small), mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
