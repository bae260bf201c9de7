"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys' hashes, sorted, with the number of documents that hold each.  Documents come in
batches.  A batch is counted, merge-anti-joined with the keys that the runs already know in enough documents
(those need no more counting) and written as a run of level 0; ``fan_in`` runs of a level are merged into one of the
next, so each count is rewritten once per level.  After the last batch the lines of known keys leave every document.

A line's hash is 128 bits (two XXH64 with different seeds).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.llm.common import land, pick, settle, whole_text
from faultlens.session import scratch_path

_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashed before the key, it gives the second hash its seed.
_SECOND = "second"
_SEED = xxhash.xxh64_intdigest(_SECOND.encode(), 42)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def line_hashes(line: bytes) -> tuple[int, int] | None:
    """The two signed hashes of a line's key; None for an empty key."""
    key = line.strip(_SPACES.encode()).lower()
    if not key:
        return None
    return tuple((h - (1 << 64) if h >> 63 else h) for h in (xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, _SEED)))


class LineRuns:
    """Levels of sorted runs ``(h1, h2, n)`` in the shared folder."""

    def __init__(self, spark: SparkSession, enough: int, fan_in: int = 3):
        self.spark, self.enough, self.fan_in = spark, enough, fan_in
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = scratch_path(self.spark, f"line-run-{level}")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(parts, "h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """Keys ``(h1, h2)`` that the runs know in enough documents."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(paths).where(F.col("n") >= self.enough).select("h1", "h2")

    def add(self, keys: DataFrame) -> None:
        """Count a batch ``(h1, h2)``, one row per document and key, and add its run."""
        counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        if self.levels:
            counts = counts.join(self.frequent(), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            paths, self.levels[level] = self.levels[level], []
            self._write(self._merged(paths), level + 1)
            level += 1


def line_keys(own: DataFrame) -> DataFrame:
    """``(id, key, h1, h2)``: the different non-empty line keys of each document ``own(id, key, text)``."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: k != "")
    hashed = F.array_distinct(F.transform(lines, lambda k: F.struct(
        F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(_SECOND), k).alias("h2"))))
    return own.select("id", "key", F.explode(hashed).alias("h")).select("id", "key", "h.h1", "h.h2")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: int = 6,
               fan_in: int = 3) -> DataFrame:
    """One row per input row: ``id_col, n_lines, n_dropped, kept_sha256``.

    Lines whose key (ends stripped of space and tab to carriage return, A-Z lowered) has at least one code point and
    occurs in at least ``min_docs`` documents go from every document. Null and empty texts are one empty line. Every
    row counts as a document, also repeated ones and rows without id. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    own = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    own = own.select("id", F.xxhash64("id", "text").alias("key"), "text")
    keys = land(line_keys(own).withColumn("batch", F.pmod("key", F.lit(batches)).cast("int")), "line-keys")
    runs = LineRuns(spark, min_docs, fan_in)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch).select("h1", "h2"))
    # settled, so that the join has a plain exchange on both sides and Spark can split a very common line
    hits = (keys.join(settle(runs.frequent()), ["h1", "h2"]).groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"))
            .agg(F.collect_set(F.struct("h1", "h2")).alias("drop")))
    joined = own.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    kind = own.schema["id"].dataType.simpleString()

    def run(found):
        for batch in found:
            lines, gone, digests = [], [], []
            for text, drop in zip(batch.column(1), batch.column(2)):
                parts = text.as_py().encode().split(b"\n")
                kept = parts
                if drop.is_valid:
                    out = set(zip(drop.values.field("h1").to_pylist(), drop.values.field("h2").to_pylist()))
                    kept = [p for p in parts if line_hashes(p) not in out]
                lines.append(len(parts))
                gone.append(len(parts) - len(kept))
                digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                ["id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.select("id", "text", "drop").mapInArrow(
        run, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("id", id_col)
