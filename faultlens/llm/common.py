"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.session import scratch_path, shared_dir

#: The white space of every contract here: space and the control characters tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable storage: losing an executor afterwards loses no part of it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back (column pruning and pushdown still work)."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of the input can't clash with an operator's own names."""
    return docs.select(*[docs[n].alias(n) for n in names])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it (Spark ignores case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def worker_state() -> dict:
    """What this Python process keeps from task to task: the namespace of a module that exists only in memory.

    Task functions travel by value, so globals of this package would be new in each task. For things that are costly to
    build and of fixed size, such as a tokenizer; never for what is learned from rows.
    """
    return vars(sys.modules.setdefault("faultlens_worker_state", types.ModuleType("faultlens_worker_state")))
