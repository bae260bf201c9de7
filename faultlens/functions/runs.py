"""Run-level expressions: job id in job output, fault name, run folder name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
JOB_ID_PATTERN = r"job_\d+_\d+"
SCRIPT_PREFIX = "inject_"
# -------------------------------------------------------------------------------


def job_id_in_line(line: Column) -> Column:
    """First ``job_<n>_<n>`` in a line, NULL when absent."""
    return F.regexp_substr(line, F.lit(JOB_ID_PATTERN))


def fault_from_script(path: Column) -> Column:
    """``/x/inject_data_skew.sh`` -> ``data_skew``."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.replace(F.split_part(base, F.lit("."), F.lit(1)), F.lit(SCRIPT_PREFIX), F.lit(""))


def run_folder(fault: Column, job_id: Column, stamp: Column) -> Column:
    """``<fault>_<job>_<yyyyMMdd_HHmmss>``; the job part is skipped when NULL."""
    return F.concat_ws("_", fault, job_id, stamp)
