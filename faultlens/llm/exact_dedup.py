"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition is one run: its digests in order, each with the smallest identifier and the row count. Runs are
merged in binomial rounds of ``fan_in`` ways: in a round of step ``s`` (1, ``fan_in``, ``fan_in`` squared and so on) the runs whose
number is a multiple of ``fan_in * s`` take in the runs ``s, 2s, ...`` behind them, until run 0 is left.

A round deals its rows by ranges of (run, digest) and sorts them there, so a merge reads its runs in digest order and a
long run is cut into ranges that different tasks merge; the merged run is kept in that order. A text that a third of
all rows share reaches any task of a round with at most ``fan_in`` rows: hot groups shrink on the way up instead of meeting in
one task. The answers return down the same tree.

A group key holds a 64-bit digest, the byte length and the SHA-256 of the normalised text; rows that agree only in the
short digest never merge, so each retained identifier is verified at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import SPACE_CLASS, pick, settle, unused, whole_text

_KEY = ["digest", "n_bytes", "sha"]


def normalised(text_col: str = "text"):
    """Each run of white space as one space; null is the empty text."""
    return F.regexp_replace(whole_text(text_col), SPACE_CLASS + "+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, n_bytes, sha, run, row)`` of every row; the run is the input partition it was read in."""
    text = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return settle(text.select(
        "id", F.xxhash64("norm").alias("digest"), F.octet_length("norm").alias("n_bytes"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row")))


def merged(runs: DataFrame) -> DataFrame:
    """``runs(run, digest, n_bytes, sha, best, group_size)`` with the rows of a run in digest order, one for each key."""
    # the ranges of (run, digest) keep a key in one task, and the order serves the aggregate: no second exchange or sort
    ordered = runs.repartitionByRange("run", "digest").sortWithinPartitions("run", *_KEY)
    return ordered.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


def merge_tree(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """Add ``best`` (struct: absent, id, row) and ``group_size`` to the rows of :func:`digests`."""
    first = F.struct(F.col("id").isNull().alias("absent"), "id", "row")
    levels = [settle(merged(rows.select("run", *_KEY, first.alias("best"), F.lit(1).cast("long").alias("group_size"))))]
    last, step = rows.agg(F.max("run")).first()[0] or 0, 1

    def receiver(step: int):
        return F.expr(f"cast(run - pmod(run, {fan_in * step}L) as int)")

    steps = []
    while step <= last:
        levels.append(settle(merged(levels[-1].withColumn("run", receiver(step)))))
        steps.append(step)
        step *= fan_in
    answer = levels.pop()
    while levels:
        below = levels.pop().select("run", *_KEY).withColumn("up", receiver(steps.pop()))
        answer = below.join(answer.withColumnRenamed("run", "up"), ["up", *_KEY]).drop("up")
    return rows.join(answer, ["run", *_KEY])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after white-space runs become one space; null
    counts as empty.  The row with the smallest id stays.  A null id loses to
    any other; of rows that repeat the same id and text, the first read stays.
    An empty table gives no rows.  Columns besides the two named are ignored.
    """
    found = merge_tree(digests(docs, id_col, text_col), fan_in)
    return found.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts the smallest id stays (a null id loses to any other); of rows that repeat that id and text one stays.
    Null and empty texts are equal. An empty table gives no rows. Whole rows are shuffled once.
    """
    key = unused(docs, "kept_key")
    kept = exact_dedup(docs, id_col, text_col, fan_in).where("kept").select(
        F.concat_ws(":", "text_sha256", F.col(id_col).cast("string")).alias(key)).distinct()
    own = F.concat_ws(":", F.sha2(normalised(text_col).cast("binary"), 256), F.col(id_col).cast("string"))
    # both steps need the rows of a key together: one exchange serves them
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
