"""DuckDB SQL renderings of the tagging/parsing expressions, for the oracles only."""

from __future__ import annotations

from faultlens.functions import logs as L


def node(f: str) -> str:
    """Node of a log path (DuckDB form of the Spark expression)."""
    cands = ", ".join(f"nullif(regexp_extract({f}, '{p}', 1), '')" for p in L.NODE_PATTERNS)
    return (f"CASE WHEN {f} IS NULL OR {f} = '' THEN 'unknown' ELSE coalesce({cands}, "
            f"'cpf-' || nullif(regexp_extract({f}, '{L.TASK_NODE_PATTERN}', 1), ''), 'unknown') END")


def task_id(f: str) -> str:
    """Task id of a log path, NULL when absent."""
    return f"nullif(regexp_extract({f}, '{L.TASK_ID_PATTERN}', 1), '')"


def component(f: str) -> str:
    """Daemon component of a log path."""
    return (f"CASE WHEN {f} IS NULL OR {f} = '' THEN 'unknown' "
            f"WHEN contains({f}, 'datanode') THEN 'datanode' "
            f"WHEN contains({f}, 'namenode') AND contains({f}, 'secondary') THEN 'secondarynamenode' "
            f"WHEN contains({f}, 'namenode') THEN 'namenode' "
            f"WHEN contains({f}, 'nodemanager') THEN 'nodemanager' "
            f"WHEN contains({f}, 'resourcemanager') THEN 'resourcemanager' ELSE 'mapreduce' END")


def level(m: str) -> str:
    """Level word found in a message."""
    whens = " ".join(f"WHEN contains(upper({m}), '{w}') THEN '{lv}'" for w, lv in L.LEVEL_ORDER)
    return f"CASE WHEN {m} IS NULL OR {m} = '' THEN 'unknown' {whens} ELSE '{L.DEFAULT_LEVEL}' END"


def tags(f: str = "filename") -> str:
    """component, node and task_id select items for a path column."""
    return f"{component(f)} AS component, {node(f)} AS node, {task_id(f)} AS task_id"


PARSED_SQL = f"""
SELECT event_id, filename, line_ts, strftime(line_ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp,
       epoch_us(line_ts) * 1000 AS timestamp_ns, {level('message')} AS level, message, {tags()}
FROM (SELECT event_id, filename,
        coalesce(try_strptime(p1 || ' ' || p2, '%Y-%m-%d %H:%M:%S,%f'),
                 try_strptime(p1 || ' ' || p2, '%Y-%m-%d %H:%M:%S')) AS line_ts,
        regexp_replace(p3, '^\\s+|\\s+$', '', 'g') AS message
      FROM (SELECT event_id, filename,
              regexp_extract(line, '^([^ ]*) ([^ ]*) ([\\s\\S]*)$', 1) AS p1,
              regexp_extract(line, '^([^ ]*) ([^ ]*) ([\\s\\S]*)$', 2) AS p2,
              regexp_extract(line, '^([^ ]*) ([^ ]*) ([\\s\\S]*)$', 3) AS p3
            FROM raw_log WHERE regexp_matches(line, '^[^ ]* [^ ]* ')))
WHERE line_ts IS NOT NULL
"""

STORE_SQL = f"""
SELECT event_id, ts AS line_ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, epoch_us(ts) * 1000 AS timestamp_ns,
       filename, {level('line')} AS level, line AS message, {tags()}
FROM raw_log
"""
