"""Small constant dimensions of the cluster under study.

All tables here are literal and fixed-size (tens of rows), so broadcasting them
or inlining them as MAP literals is safe at any data scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (cluster description the datasets are labelled with) ----------
NODE_ROLES = {
    "cpf-1": ["namenode", "resourcemanager", "historyserver"],
    "cpf-2": ["datanode", "nodemanager"],
    "cpf-3": ["datanode", "nodemanager"],
    "cpf-4": ["datanode", "nodemanager"],
}
SERVICE_ENDPOINTS = {
    "namenode": ["cpf-1:9402"],
    "datanode": ["cpf-2:9401", "cpf-3:9401", "cpf-4:9401"],
    "resourcemanager": ["cpf-1:9403"],
    "nodemanager": ["cpf-2:9404", "cpf-3:9404", "cpf-4:9404"],
    "historyserver": ["cpf-1"],
}
# fault type -> (description, affected nodes, affected services, injection method, nodes known)
FAULT_CATALOGUE = {
    "data_skew": ("data skew", ["cpf-2", "cpf-3", "cpf-4"], ["nodemanager"],
                  "hot key injected in the mapper", True),
    "data_bloat": ("data bloat", ["cpf-2", "cpf-3", "cpf-4"], ["datanode", "nodemanager"],
                   "large intermediate data", True),
    "task_fail": ("task failure", ["cpf-2", "cpf-3", "cpf-4"], ["nodemanager"],
                  "map tasks killed at random", True),
    "network_latency": ("network latency", [], ["all"], "tc delay", False),
    "cpu_load": ("cpu load", [], ["nodemanager"], "cpu-bound process", False),
    "memory_pressure": ("memory pressure", [], ["nodemanager"], "memory consumer", False),
}
# Row used for a fault type missing from the catalogue.
UNKNOWN_FAULT = ("unknown fault", [], ["nodemanager"], "unknown", False)
IP_TO_HOST = {
    "10.10.3.183": "cpf-1",
    "10.10.1.96": "cpf-2",
    "10.10.3.222": "cpf-3",
    "10.10.0.176": "cpf-4",
}
INSTANCE_TO_HOST = {
    "cpf-1:9100": "cpf-1", "cpf-2:9100": "cpf-2", "cpf-3:9100": "cpf-3", "cpf-4:9100": "cpf-4",
    "cpf-1:9402": "cpf-1", "cpf-2:9401": "cpf-2", "cpf-3:9401": "cpf-3", "cpf-4:9401": "cpf-4",
    "cpf-2:9404": "cpf-2", "cpf-3:9404": "cpf-3", "cpf-4:9404": "cpf-4", "cpf-1:9403": "cpf-1",
}
SERVICE_PORTS = {
    "9100": "node_exporter",
    "9401": "datanode",
    "9402": "namenode",
    "9403": "resourcemanager",
    "9404": "nodemanager",
}
STATIC_LOG_TYPES = ["hadoop_logs", "hdfs_logs", "yarn_logs", "nodemanager",
                    "resourcemanager", "datanode", "namenode", "historyserver"]
METRIC_CATALOGUE = {
    "cpu": [
        "rate(node_cpu_seconds_total{mode='user'}[1m])",
        "rate(node_cpu_seconds_total{mode='system'}[1m])",
        "rate(node_cpu_seconds_total{mode='idle'}[1m])",
        "rate(node_cpu_seconds_total{mode='iowait'}[1m])",
        "node_load1", "node_load5", "node_load15",
    ],
    "memory": [
        "node_memory_MemTotal_bytes", "node_memory_MemAvailable_bytes", "node_memory_MemFree_bytes",
        "node_memory_Buffers_bytes", "node_memory_Cached_bytes", "node_memory_SwapFree_bytes",
        "node_memory_SwapTotal_bytes", "node_memory_SwapCached_bytes", "node_memory_Active_bytes",
        "node_memory_Inactive_bytes",
    ],
    "disk": [
        "node_disk_io_time_seconds_total", "node_disk_read_bytes_total", "node_disk_written_bytes_total",
        "node_disk_reads_completed_total", "node_disk_writes_completed_total", "node_filesystem_avail_bytes",
        "node_filesystem_size_bytes", "node_filesystem_files_free", "node_filesystem_files",
    ],
    "network": [
        "node_network_receive_bytes_total", "node_network_transmit_bytes_total",
        "node_network_receive_errs_total", "node_network_transmit_errs_total",
        "node_network_receive_packets_total", "node_network_transmit_packets_total",
    ],
}
DEFAULT_METRIC_CATEGORIES = ["cpu", "memory"]
# Plan defaults: order when absent, per-run collection window parameters.
DEFAULT_ORDER = 999
DEFAULT_RUN_PARAMS = {"minutes_before": 3, "minutes_after": 5, "wait_minutes": 1}
# -------------------------------------------------------------------------------

FAULT_SCHEMA = T.StructType([
    T.StructField("fault_type", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("affected_nodes", T.ArrayType(T.StringType(), False), False),
    T.StructField("affected_services", T.ArrayType(T.StringType(), False), False),
    T.StructField("injection_method", T.StringType(), False),
    T.StructField("nodes_known", T.BooleanType(), False),
])


def fault_catalogue(spark: SparkSession) -> DataFrame:
    """The fault catalogue as a DataFrame (6 rows)."""
    rows = [(k, *v) for k, v in FAULT_CATALOGUE.items()]
    return spark.createDataFrame(rows, FAULT_SCHEMA)


def node_roles(spark: SparkSession) -> DataFrame:
    """Node -> roles (4 rows)."""
    return spark.createDataFrame(list(NODE_ROLES.items()), "node string, roles array<string>")


def service_endpoints(spark: SparkSession) -> DataFrame:
    """Service -> host:port endpoints (5 rows)."""
    return spark.createDataFrame(list(SERVICE_ENDPOINTS.items()), "service string, endpoints array<string>")


def metric_catalogue(spark: SparkSession) -> DataFrame:
    """Metric category -> query text (32 rows)."""
    rows = [(cat, q) for cat, qs in METRIC_CATALOGUE.items() for q in qs]
    return spark.createDataFrame(rows, "category string, query string")


def sql_values(rows, columns) -> str:
    """Render literal rows as a SQL VALUES relation (used by the DuckDB oracles)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"
