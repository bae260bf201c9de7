"""Known answers at sf0.01 (FIXTURES.md section C)."""

from faultlens.plans.catalog import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.01"


def test_wordcount_totals(spark):
    from pyspark.sql import functions as F
    wc = QUERIES["wordcount"](spark, SF)
    row = wc.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    assert (row.tokens, row.words) == (390171, 93796)


def test_counts(spark):
    assert QUERIES["bloat_expand"](spark, SF).count() == 37376
    assert QUERIES["log_parse_lines"](spark, SF).count() == 9090
    assert QUERIES["log_level"](spark, SF).count() == 48
    assert QUERIES["log_topn_per_file"](spark, SF).count() == 1400
    assert QUERIES["metric_instant"](spark, SF).count() == 10828  # grid over the whole month
    assert QUERIES["metric_increase"](spark, SF).count() == 13232
    assert QUERIES["metric_rate"](spark, SF).count() == 13232
    assert QUERIES["silence_gaps"](spark, SF).count() == 148


def test_ip_groups(spark):
    from pyspark.sql import functions as F
    rec = QUERIES["ip_reclassify"](spark, SF)
    groups = {r.ip: r.n for r in rec.groupBy("ip").agg(F.count("*").alias("n")).collect()}
    assert len(groups) == 4 and groups[None] == 910
