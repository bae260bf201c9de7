"""Session helpers: build a session for tests/bench and find the shared folder.

On a cluster the session comes from the platform; the library only *reads*
``spark.checkpoint.dir`` from it.  A folder of our own is set only when the
setting is absent (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "faultlens", extra: dict | None = None) -> SparkSession:
    """Session used by tests and bench (local mode); cluster jobs bring their own."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst",
                os.environ.get("FAULTLENS_PARALLELISM_FIRST", "true"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoints of intermediate tables are removed once their DataFrames are gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints",
                os.environ.get("FAULTLENS_CLEAN_CHECKPOINTS", "true"))
        .config("spark.driver.memory", os.environ.get("FAULTLENS_DRIVER_MEM", "16g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Check the settings that queries rely on; the caller's session is never changed."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "Universal", "Etc/Universal"):
        warnings.warn(f"event times are read as UTC, the session's time zone is {zone}", stacklevel=3)
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        warnings.warn("adaptive execution is off: skewed joins are not split", stacklevel=3)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local master (tests) may leave
    it unset: then a fresh local folder is created.  On a cluster that folder would be
    invisible to the executors, so an unset folder raises.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="faultlens-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/faultlens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for one written table, below a folder of this application."""
    return f"{_scratch_root(spark)}/{name}/{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession, name: str | None = None) -> bool:
    """Remove this application's written tables (those called ``name``, or all) once no DataFrame needs them.

    Results that read a written table are lazy, so the library never removes one by itself.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark) + (f"/{name}" if name else ""))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
