"""Log files as a source: one row per line with the file's path as a column.

* :func:`read_log_files` - plain files (globs or folders); the path comes from the
  file-source metadata column, decoded, so node/task tagging works on the real path.  Files that
  vanish between listing and reading are skipped (a collector racing log rotation).
* :func:`read_log_tree` - a landing tree partitioned by the original path
  (``filename=<escaped path>/part-*.txt``): the path comes back by partition discovery.

Text files split across tasks by size; nothing is read whole on the driver.  Bytes that are
not valid UTF-8 are dropped, as a reader decoding with ``errors="ignore"`` does; a genuine
U+FFFD stays.  A damaged (truncated compressed) file fails the read, it is never cut short silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.sinks.files import deal_out

_REPLACEMENT = "\ufffd"
#: Stands for a genuine U+FFFD while invalid bytes are being replaced by U+FFFD and dropped.
_GENUINE = "\ue000fffd\ue001"


def _decoded(value_col: str = "value"):
    kept = F.replace(F.col(value_col), F.lit(_REPLACEMENT), F.lit(_GENUINE))
    return F.replace(F.translate(F.make_valid_utf8(kept), _REPLACEMENT, ""), F.lit(_GENUINE), F.lit(_REPLACEMENT))


def real_path(uri):
    """The path of a ``file:`` URI as it is on disk (percent escapes decoded, a plus sign kept)."""
    decoded = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(decoded, r"^file:(//(?=/))?", "")


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths (or globs with at least one match) that exist: a metadata check, no data read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    keep = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        matches = fs.globStatus(hp)
        if matches is not None and len(matches) > 0:
            keep.append(p)
    return keep


def read_log_files(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """Lines of plain log files (paths, folders or globs) with their real path as ``filename``."""
    paths = existing_paths(spark, paths if isinstance(paths, list) else [paths])
    reader = (spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "false")
              .option("recursiveFileLookup", str(recursive).lower()))
    if not paths:
        return spark.createDataFrame([], "filename string, line string")
    df = reader.text(paths)
    return df.select(real_path(F.col("_metadata.file_path")).alias("filename"), _decoded().alias("line"))


def write_log_tree(lines: DataFrame, root: str, key_col: str, path_col: str = "filename", line_col: str = "line",
                   rows_per_writer: int = 1_000_000) -> str:
    """Land lines as text, one folder per original path.

    A path is written by ``ceil(rows / rows_per_writer)`` tasks, from its measured row count; rows are dealt by the row
    key ``key_col``, so repeated lines of a hot path spread too.
    """
    dealt = deal_out(lines.select(key_col, path_col, line_col), [path_col], key_col, rows_per_writer)
    dealt.drop(key_col).write.mode("overwrite").partitionBy(path_col).text(root)
    return root


def read_log_tree(spark: SparkSession, root: str, path_col: str = "filename") -> DataFrame:
    """Lines of a landing tree written by :func:`write_log_tree`, with the original path."""
    df = spark.read.option("ignoreMissingFiles", "true").text(root)
    return df.select(F.col(path_col).cast("string").alias("filename"), _decoded().alias("line"))
