"""Partitioned file sinks and the matching readers.

One directory per (node, component) - or (node, task), (hostname, metric) - as in the
reference's per-node folders.  A partition value is split over as many writer tasks as its
measured row count asks for (several part files per folder, each sorted by time), so no single
task writes a third of the data; ``maxRecordsPerFile`` bounds file size.

Folder names are read back as text, never retyped (``007`` stays ``007``).  NULL is Spark's default
partition; an empty string, which would share that folder, is written under :data:`EMPTY`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators.ordering import join_null_safe, materialize_sized, maybe_broadcast

CSV_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               # NULL as \N keeps NULL and '' apart (absent labels are '', missing task ids NULL);
               # only a field that is exactly \N would read back as NULL
               "nullValue": "\\N"}


#: Folder name of an empty partition value; a value that begins with it gets it once more in front.
EMPTY = "__empty__"


def _folder(col: str):
    value = F.col(col).cast("string")
    return F.when((value == "") | value.startswith(EMPTY), F.concat(F.lit(EMPTY), value)).otherwise(value)


def _from_folder(col: str):
    return F.when(F.col(col).startswith(EMPTY), F.substring(F.col(col), len(EMPTY) + 1, 2**31 - 1)).otherwise(F.col(col))


def deal_out(df: DataFrame, partition_cols: list[str], key_col: str, rows_per_writer: int) -> DataFrame:
    """``df`` dealt so that a partition value goes to ``ceil(rows / rows_per_writer)`` tasks, by a hash of the row key."""
    counts, seen = materialize_sized(df.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("_n")))
    writers = counts.select(*partition_cols, F.ceil(F.col("_n") / F.lit(rows_per_writer)).alias("_writers"))
    salted = join_null_safe(df, maybe_broadcast(writers, rows=seen["rows"], size=seen["bytes"]), partition_cols)
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(F.col(key_col)), F.col("_writers")))
    return salted.repartition(*[F.col(c) for c in partition_cols], F.col("_salt")).drop("_salt", "_writers")


def write_partitioned_csv(df: DataFrame, path: str, partition_cols: list[str], sort_cols: list[str],
                          salt_source: str, rows_per_writer: int = 1_000_000, max_records_per_file: int = 1_000_000,
                          mode: str = "overwrite") -> str:
    """Write CSV folders per partition value; large values are dealt over several writers by ``salt_source``."""
    named = df.withColumns({c: _folder(c) for c in partition_cols})
    laid_out = deal_out(named, partition_cols, salt_source, rows_per_writer).sortWithinPartitions(*partition_cols, *sort_cols)
    (laid_out.write.mode(mode).partitionBy(*partition_cols).options(**CSV_OPTIONS)
     .option("maxRecordsPerFile", max_records_per_file).csv(path))
    return path


def read_partitioned_csv(spark: SparkSession, path: str, schema: T.StructType, partition_cols: list[str]) -> DataFrame:
    """All ``*.csv`` files under ``path`` with the folder names as text columns ``partition_cols``."""
    whole = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in partition_cols]])
    back = spark.read.options(**CSV_OPTIONS).option("pathGlobFilter", "*.csv").schema(whole).csv(path)
    return back.withColumns({c: _from_folder(c) for c in partition_cols})


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON object per row (NULL fields kept as explicit nulls)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read JSON lines with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def read_key_value_text(spark: SparkSession, path: str, key: str, value: str,
                        value_type: str = "long") -> DataFrame:
    """Read ``key<TAB>value`` text back into two typed columns."""
    lines = spark.read.text(path)
    return lines.select(F.split_part("value", F.lit("\t"), F.lit(1)).alias(key),
                        F.split_part("value", F.lit("\t"), F.lit(2)).cast(value_type).alias(value))


def write_key_value_text(df: DataFrame, path: str, key: str, value: str, mode: str = "overwrite") -> str:
    """Replace-on-write ``key<TAB>value`` text output (the MapReduce job's part files)."""
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")) \
        .write.mode(mode).text(path)
    return path
