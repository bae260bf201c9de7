"""Registered queries of the corpus operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultlens.llm import (ann_adaptive, exact_dedup, html_extract, langid, line_dedup, lm_score, packing, pii, sentencepiece_codec, simhash,
                           spelling, substring_dedup,
                           token_align)
from faultlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


@_register()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@_register()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_register()
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@_register()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.train(docs))


@_register(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@_register()
def op2_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_adaptive.search(table(spark, sf_dir, "embeddings"))


@_register(r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@_register(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS start FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, start, sha256(array_to_string(words[start:start + 49], ' ')) AS win FROM s),
g AS (SELECT win, min(doc_id) AS low FROM h GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS pos FROM h JOIN g USING (win) WHERE low < doc_id),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT p.doc_id, count(*) FILTER (r.pos IS NOT NULL) AS gone,
             string_agg(word, ' ' ORDER BY p.pos) FILTER (r.pos IS NULL) AS kept
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@_register()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_register()
def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


@_register(r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
             lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
r AS (SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
      WHERE length(run) >= 7 GROUP BY doc_id, run),
x AS (SELECT run, n, doc_id, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM r),
b AS (SELECT run, n, list_transform(range(1, length(h), 2), lambda p: 16 * (strpos('0123456789ABCDEF', substr(h, p, 1)) - 1)
             + strpos('0123456789ABCDEF', substr(h, p + 1, 1)) - 1) AS bytes FROM x),
s AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, y: xor(a // 256, tab[xor(a, y) % 256 + 1])), 4294967295) AS crc
      FROM b, c),
d AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2)
                  ELSE run END AS word, n FROM s),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.rest = w.word
      UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.rest = w.word),
q AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS nth FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
             CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN q ON w.word = q.word AND nth = 1),
g AS (WITH RECURSIVE go AS (SELECT word, word AS root, 0 AS steps FROM f
                            UNION ALL SELECT go.word, f.form, steps + 1 FROM go JOIN f ON go.root = f.word WHERE f.form IS NOT NULL)
      SELECT word, arg_max(root, steps) AS root FROM go GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word)""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@_register()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))


@_register()
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
