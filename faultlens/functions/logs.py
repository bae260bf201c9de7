"""Log tagging and parsing expressions (file path -> node/component/task, line -> fields)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.text import py_strip

# --- fixed values (must equal the reference for identical tagging) -------------
# Node patterns, tried in this order; the first match wins.  Group 1 is the node,
# except the last one (task container folder "cpf-<n>_<port>") which yields "cpf-<n>".
NODE_PATTERNS = [
    r"datanode-(cpf-\d+)",
    r"namenode-(cpf-\d+)",
    r"nodemanager-(cpf-\d+)",
    r"resourcemanager-(cpf-\d+)",
    r"secondarynamenode-(cpf-\d+)",
]
TASK_NODE_PATTERN = r"cpf-(\d+)_(\d+)"
TASK_ID_PATTERN = r"application_(\d+_\d+)"
# Level words checked in this order as case-insensitive substrings; FATAL maps to ERROR.
LEVEL_ORDER = [("FATAL", "ERROR"), ("ERROR", "ERROR"), ("WARN", "WARN"), ("INFO", "INFO"),
               ("DEBUG", "DEBUG"), ("TRACE", "TRACE")]
DEFAULT_LEVEL = "INFO"
# Line time formats: with a comma fraction (1-6 digits, like %f) and without.
LINE_TS_FORMATS = ["yyyy-M-d H:m:s,SSSSSS", "yyyy-M-d H:m:s"]
IPV4_PATTERN = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
# -------------------------------------------------------------------------------


def _blank(col: Column) -> Column:
    return col.isNull() | (col == "")


def node_from_filename(f: Column) -> Column:
    """Node of a log path; ``unknown`` when blank or unmatched."""
    candidates = [F.nullif(F.regexp_extract(f, p, 1), F.lit("")) for p in NODE_PATTERNS]
    task_node = F.nullif(F.regexp_extract(f, TASK_NODE_PATTERN, 1), F.lit(""))
    candidates.append(F.concat(F.lit("cpf-"), task_node))
    return F.when(_blank(f), F.lit("unknown")).otherwise(F.coalesce(*candidates, F.lit("unknown")))


def task_id_from_filename(f: Column) -> Column:
    """``<cluster ts>_<seq>`` of an ``application_`` path, else NULL."""
    return F.nullif(F.regexp_extract(f, TASK_ID_PATTERN, 1), F.lit(""))


def component_from_filename(f: Column) -> Column:
    """Daemon component by substring; anything else is ``mapreduce``."""
    return (
        F.when(_blank(f), F.lit("unknown"))
        .when(f.contains("datanode"), F.lit("datanode"))
        .when(f.contains("namenode") & f.contains("secondary"), F.lit("secondarynamenode"))
        .when(f.contains("namenode"), F.lit("namenode"))
        .when(f.contains("nodemanager"), F.lit("nodemanager"))
        .when(f.contains("resourcemanager"), F.lit("resourcemanager"))
        .otherwise(F.lit("mapreduce"))
    )


def level_from_message(m: Column) -> Column:
    """First level word found (substring, any case); none -> INFO; blank -> unknown."""
    up = F.upper(m)
    expr = F.when(_blank(m), F.lit("unknown"))
    for word, level in LEVEL_ORDER:
        expr = expr.when(up.contains(word), F.lit(level))
    return expr.otherwise(F.lit(DEFAULT_LEVEL))


def line_parts(line: Column) -> Column:
    """``line.split(' ', 2)`` as an array (size 3 when the line has date, time, rest)."""
    return F.split(line, " ", 3)


def parse_line_time(date_part: Column, time_part: Column) -> Column:
    """Line time as TIMESTAMP_NTZ, NULL when unparsable (the row is then dropped).

    A comma in the time part selects the fractional format, as in the reference."""
    text = F.concat(date_part, F.lit(" "), time_part)
    with_fraction, whole_seconds = (F.try_to_timestamp(text, F.lit(fmt)) for fmt in LINE_TS_FORMATS)
    return F.when(time_part.contains(","), with_fraction).otherwise(whole_seconds).cast("timestamp_ntz")


def message_of(parts: Column) -> Column:
    """The stripped text after date and time of a split line."""
    return py_strip(F.get(parts, 2))


def first_ipv4(m: Column) -> Column:
    """First dotted quad in a message (no octet range check), else NULL."""
    return F.nullif(F.regexp_extract(m, IPV4_PATTERN, 1), F.lit(""))


def mounted_path(f: Column, mount: str = "/hdfs-nfs") -> Column:
    """Where a task file is read from: paths already below the mount stay, others go below it."""
    return F.when(f.startswith(mount), f).otherwise(F.concat(F.lit(mount.rstrip("/") + "/"), F.ltrim(f, F.lit("/"))))
