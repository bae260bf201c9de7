"""Salting equals plain; generator sizes equal the reference's arithmetic."""

from faultlens.operators import mapreduce as mr
from faultlens.sources import generate as gen


def test_salted_equals_plain(spark):
    from pyspark.sql import functions as F
    pairs = spark.range(20000).select(F.col("id").alias("event_id"),
                                      F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("key"),
                                      F.lit(1).alias("value"))
    a = {r.key: r.total for r in mr.key_sum(pairs).collect()}
    b = {r.key: r.total for r in mr.salted_key_sum(pairs, salts=8, salt_source=F.col("event_id")).collect()}
    assert a == b == {"hot": 19600, "cold": 400}


def test_generator_arithmetic_matches_reference_sizes():
    nb = gen.skew_batches(gen.REFERENCE_TARGET_BYTES)
    assert nb == 641
    assert nb * gen.SKEW_HOT_PER_BATCH == 396_618_750 and nb * gen.SKEW_COLD_PER_BATCH == 3_560_755
    assert gen.bloat_rows(gen.REFERENCE_TARGET_BYTES) == 28_210_216
    assert len(gen.BLOAT_TEXT) + 1 == 95


def test_bloat_lines_small(spark):
    rows = gen.bloat_rows(50_000, per_batch=100)
    df = gen.bloat_lines(spark, 50_000, per_batch=100)
    assert df.count() == rows
    first = df.orderBy("line_id").first().line
    assert first.startswith("bloat_key_0\tVeryLarge")
