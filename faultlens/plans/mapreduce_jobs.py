"""Registered queries: MapReduce dataflows (SRC1, SRC11-12, P1-P3, A1-A2, A4, A11, W7-W8, R1, SNK7-8)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultlens.operators import mapreduce as mr
from faultlens.plans.catalog import cte, register
from faultlens.session import prepare
from faultlens.sources import fixtures as fx
from faultlens.sources import generate as gen
from faultlens.sources.tables import read_table

TOKENS_SQL = """
SELECT doc_id, line_no, word FROM (
  SELECT doc_id, line_no, unnest(string_split_regex(line, '\\s+')) AS word FROM text_line)
WHERE word <> ''
"""


@register("line_scan", oracle=cte(text_line=fx.TEXT_LINE_SQL) + "SELECT doc_id, line_no, line FROM text_line")
def line_scan(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return fx.text_line(spark, sf_dir)


@register("tokenize", oracle=cte(text_line=fx.TEXT_LINE_SQL) + TOKENS_SQL)
def tokenize(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.tokenize(fx.text_line(spark, sf_dir))


WORDCOUNT_SQL = cte(text_line=fx.TEXT_LINE_SQL, tokens=TOKENS_SQL) + "SELECT word, count(*) AS n FROM tokens GROUP BY word"


@register("wordcount", oracle=WORDCOUNT_SQL)
def wordcount(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.word_count(mr.tokenize(fx.text_line(spark, sf_dir), keep=()))


@register("preview_top10", oracle=cte(text_line=fx.TEXT_LINE_SQL, tokens=TOKENS_SQL)
          + "SELECT word, count(*) AS n FROM tokens GROUP BY word ORDER BY word LIMIT 10")
def preview_top10(spark: SparkSession, sf_dir: str):
    """First ten output lines of the word-count job in key order (a top-k: the limit is the feature)."""
    prepare(spark)
    return wordcount(spark, sf_dir).orderBy("word").limit(10)


SKEW_MAP_SQL = """
SELECT event_id, CASE WHEN starts_with(trim(line), 'hot_key') THEN 'hot_key' ELSE 'cold_key' END AS key,
       1 AS value FROM skew_line
"""


@register("skew_map", oracle=cte(skew_line=fx.SKEW_LINE_SQL) + SKEW_MAP_SQL)
def skew_map(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.skew_map(fx.skew_line(spark, sf_dir))


SKEW_SUM_SQL = cte(skew_line=fx.SKEW_LINE_SQL, pairs=SKEW_MAP_SQL) + \
    "SELECT key, CAST(sum(value) AS BIGINT) AS total FROM pairs WHERE key <> '' GROUP BY key"


@register("skew_sum", oracle=SKEW_SUM_SQL)
def skew_sum(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.key_sum(mr.skew_map(fx.skew_line(spark, sf_dir)))


@register("skew_sum_salted", oracle=SKEW_SUM_SQL)
def skew_sum_salted(spark: SparkSession, sf_dir: str):
    prepare(spark)
    pairs = mr.skew_map(fx.skew_line(spark, sf_dir))
    return mr.salted_key_sum(pairs, salts=16, salt_source=F.col("event_id"))


@register("skew_profile", oracle=cte(skew_line=fx.SKEW_LINE_SQL, pairs=SKEW_MAP_SQL,
                                     per_key="SELECT key, count(*) AS n FROM pairs GROUP BY key") + """
SELECT key, n, round(n / (SELECT sum(n) FROM per_key), 6) AS share,
       round((SELECT max(n) / avg(n) FROM per_key), 6) AS max_over_mean
FROM per_key""")
def skew_profile(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.key_shares(mr.skew_map(fx.skew_line(spark, sf_dir)))


@register("skew_partitions", oracle=cte(skew_line=fx.SKEW_LINE_SQL) + """
SELECT CAST(CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) % 8 AS INTEGER) AS partition, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM skew_line), 6) AS share
FROM (SELECT CASE WHEN starts_with(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 'hot_key') THEN 'hot_key' ELSE 'cold_key' END AS key
      FROM skew_line)
GROUP BY 1""")
def skew_partitions(spark: SparkSession, sf_dir: str):
    """Rows per reducer under an explicit 8-way key partitioner (W8)."""
    prepare(spark)
    return mr.partition_shares(mr.skew_map(fx.skew_line(spark, sf_dir)), num_partitions=8)


BLOAT_SQL = """
SELECT doc_id, line_no, c.copy AS copy,
       regexp_replace(line, '^\\s+|\\s+$', '', 'g') || chr(9) || CAST(c.copy AS VARCHAR) AS record
FROM text_line, range(0, 4) AS c(copy)
"""


@register("bloat_expand", oracle=cte(text_line=fx.TEXT_LINE_SQL) + BLOAT_SQL)
def bloat_expand(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.bloat_expand(fx.text_line(spark, sf_dir), copies=4)


@register("bloat_check", oracle=cte(text_line=fx.TEXT_LINE_SQL, expanded=BLOAT_SQL) + """
SELECT raw_lines, map_output_records, raw_lines * 10 AS expected_records,
       CAST(floor(raw_lines * 10 * 3 / 10) AS BIGINT) AS threshold,
       map_output_records > CAST(floor(raw_lines * 10 * 3 / 10) AS BIGINT) AS bloated,
       round(map_output_records / raw_lines, 6) AS ratio
FROM (SELECT count(*) AS raw_lines FROM text_line), (SELECT count(*) AS map_output_records FROM expanded)""")
def bloat_check(spark: SparkSession, sf_dir: str):
    prepare(spark)
    lines = fx.text_line(spark, sf_dir)
    return mr.bloat_check(lines, mr.bloat_expand(lines, copies=4))


@register("identity_shuffle", oracle=cte(text_line=fx.TEXT_LINE_SQL, expanded=BLOAT_SQL)
          + "SELECT doc_id, line_no, copy, record, split_part(record, chr(9), 1) AS key FROM expanded")
def identity_shuffle(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return mr.identity_shuffle(mr.bloat_expand(fx.text_line(spark, sf_dir), copies=4), ["doc_id", "line_no", "copy"])
