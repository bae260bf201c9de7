"""The log functions as SQL functions of a session: tagging and parsing without Python, from SQL alone.

``register_sql_functions(spark)`` creates temporary functions whose bodies are SQL, so Catalyst inlines them into the plan:

* ``log_node(path)``, ``log_component(path)``, ``log_task_id(path)``, ``log_level(message)`` - scalars;
* ``log_fields(line)`` - a table function (use it with LATERAL): time and message of a task-log line, no row if it has none.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from faultlens.functions import logs as L
from faultlens.functions.text import PY_WHITESPACE


def _node() -> str:
    tried = ", ".join(f"nullif(regexp_extract(path, r'{p}', 1), '')" for p in L.NODE_PATTERNS)
    return (f"CASE WHEN path IS NULL OR path = '' THEN 'unknown' ELSE coalesce({tried}, "
            f"'cpf-' || nullif(regexp_extract(path, r'{L.TASK_NODE_PATTERN}', 1), ''), 'unknown') END")


def _level() -> str:
    tried = " ".join(f"WHEN contains(upper(message), '{word}') THEN '{level}'" for word, level in L.LEVEL_ORDER)
    return f"CASE WHEN message IS NULL OR message = '' THEN 'unknown' {tried} ELSE '{L.DEFAULT_LEVEL}' END"


_COMPONENT = """CASE WHEN path IS NULL OR path = '' THEN 'unknown'
  WHEN contains(path, 'datanode') THEN 'datanode'
  WHEN contains(path, 'namenode') AND contains(path, 'secondary') THEN 'secondarynamenode'
  WHEN contains(path, 'namenode') THEN 'namenode'
  WHEN contains(path, 'nodemanager') THEN 'nodemanager'
  WHEN contains(path, 'resourcemanager') THEN 'resourcemanager' ELSE 'mapreduce' END"""


def function_sql() -> dict[str, str]:
    """``CREATE`` statements by function name."""
    scalar = "CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg} STRING) RETURNS STRING RETURN {body}"
    with_fraction, whole_seconds = L.LINE_TS_FORMATS
    time = (f"cast(CASE WHEN contains(get(p, 1), ',') THEN try_to_timestamp(concat(get(p, 0), ' ', get(p, 1)), '{with_fraction}') "
            f"ELSE try_to_timestamp(concat(get(p, 0), ' ', get(p, 1)), '{whole_seconds}') END AS timestamp_ntz)")
    return {
        "log_node": scalar.format(name="log_node", arg="path", body=_node()),
        "log_component": scalar.format(name="log_component", arg="path", body=_COMPONENT),
        "log_task_id": scalar.format(name="log_task_id", arg="path", body=f"nullif(regexp_extract(path, r'{L.TASK_ID_PATTERN}', 1), '')"),
        "log_level": scalar.format(name="log_level", arg="message", body=_level()),
        "log_fields": "CREATE OR REPLACE TEMPORARY FUNCTION log_fields(line STRING) RETURNS TABLE (line_ts TIMESTAMP_NTZ, message STRING) "
                      f"RETURN SELECT t, m FROM (SELECT {time} AS t, btrim(get(p, 2), '{PY_WHITESPACE}') AS m, size(p) AS n "
                      "FROM (SELECT split(line, ' ', 3) AS p)) WHERE n = 3 AND t IS NOT NULL",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session (they end with it); returns their names."""
    for statement in function_sql().values():
        spark.sql(statement)
    return list(function_sql())
