"""Hand rows for every branch of the tagging / parsing / label expressions."""

import datetime as dt

from pyspark.sql import functions as F

from faultlens.functions import logs as L
from faultlens.functions import metrics as M
from faultlens.functions import runs as R
from faultlens.operators import logs as ops
from faultlens.plans import dims


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_node_from_filename(spark):
    got = _one(spark, L.node_from_filename, [
        None, "", "/l/hdfs-datanode-cpf-3.log", "/l/hdfs-namenode-cpf-1.log", "/l/hdfs-secondarynamenode-cpf-1.log",
        "/l/yarn-nodemanager-cpf-4.log", "/l/yarn-resourcemanager-cpf-1.log", "/x/application_1_2/cpf-2_45454",
        "/var/log/syslog"])
    assert got == ["unknown", "unknown", "cpf-3", "cpf-1", "cpf-1", "cpf-4", "cpf-1", "cpf-2", "unknown"]


def test_task_and_component(spark):
    assert _one(spark, L.task_id_from_filename, [None, "", "/a/application_17_0001/x", "/a/application_x/y"]) == \
        [None, None, "17_0001", None]
    assert _one(spark, L.component_from_filename, [
        None, "", "a-datanode-b", "secondarynamenode", "namenode", "nodemanager", "resourcemanager", "syslog"]) == \
        ["unknown", "unknown", "datanode", "secondarynamenode", "namenode", "nodemanager", "resourcemanager",
         "mapreduce"]


def test_level_precedence(spark):
    got = _one(spark, L.level_from_message, [
        None, "", "FATAL boom", "INFO saw an error", "warn: x", "Info", "debug y", "trace z", "nothing here"])
    assert got == ["unknown", "unknown", "ERROR", "ERROR", "WARN", "INFO", "DEBUG", "TRACE", "INFO"]


def test_line_parsing_edge_cases(spark):
    rows = [
        (1, "/a/application_1_2/cpf-2_1", "2024-01-05 10:20:30,123456 INFO six digits"),
        (2, "/a/application_1_2/cpf-2_1", "2024-1-5 3:4:5 INFO one digit fields"),
        (3, "/a/application_1_2/cpf-2_1", "2024-01-05 10:20:30"),            # two tokens: dropped
        (4, "/a/application_1_2/cpf-2_1", "  at Frame"),                       # stack line: dropped
        (5, "/a/application_1_2/cpf-2_1", "2024-01-05 10:20:30,5   padded  "),
        (6, "/a/application_1_2/cpf-2_1", "not a date line"),
    ]
    raw = spark.createDataFrame(rows, "event_id long, filename string, line string")
    got = {r.event_id: r for r in ops.parse_lines(raw).collect()}
    assert sorted(got) == [1, 2, 5]
    assert got[1].line_ts == dt.datetime(2024, 1, 5, 10, 20, 30, 123456)
    assert got[1].timestamp == "2024-01-05 10:20:30.123"
    assert got[2].line_ts == dt.datetime(2024, 1, 5, 3, 4, 5)
    assert got[5].line_ts == dt.datetime(2024, 1, 5, 10, 20, 30, 500000) and got[5].message == "padded"
    assert got[1].timestamp_ns == 1704450030123456000


def test_metric_labels(spark):
    h = lambda c: M.host_from_instance(c, dims.INSTANCE_TO_HOST)
    s = lambda c: M.service_from_instance(c, dims.SERVICE_PORTS)
    vals = [None, "", "cpf-2:9401", "cpf-9:9402", "myhost", "h:7"]
    assert _one(spark, h, vals) == ["unknown", "unknown", "cpf-2", "cpf-9", "myhost", "h"]
    assert _one(spark, s, vals) == ["unknown", "unknown", "datanode", "namenode", "unknown", "port_7"]
    assert _one(spark, M.metric_name, ["rate(node_cpu_seconds_total{mode='user'}[1m])", "node_load1"]) == \
        ["rate(node_cpu_seconds_total", "node_load1"]
    assert _one(spark, M.metric_category, ["node_load1", "node_memory_x", "node_disk_io", "node_network_rx", "up"]) \
        == ["cpu", "memory", "disk", "network", "other"]


def test_run_functions(spark):
    assert _one(spark, R.job_id_in_line, ["x job_17_0001 y job_1_2", "none"]) == ["job_17_0001", None]
    assert _one(spark, R.fault_from_script, ["/scripts/data_skew/inject_data_skew.sh"]) == ["data_skew"]
    df = spark.createDataFrame([("a", None, "t"), ("a", "job_1", "t")], "f string, j string, s string")
    assert [r[0] for r in df.select(R.run_folder(F.col("f"), F.col("j"), F.col("s"))).collect()] == ["a_t", "a_job_1_t"]


def test_ip_reclassify_rows(spark):
    from faultlens.operators.detect import reclassify_by_ip
    rows = [("m 10.10.3.183 x", "datanode", None, "cpf-2"), ("from 1.2.3.4", None, "17_1", "cpf-3"),
            ("no ip", "namenode", None, None), ("", "yarn_logs", None, "cpf-1")]
    df = spark.createDataFrame(rows, "message string, component string, task_id string, node string")
    got = [(r.hostname, r.out_name) for r in reclassify_by_ip(df).collect()]
    assert got == [("cpf-1", "datanode"), ("1.2.3.4", "task_17_1"), ("unknown", "namenode"), ("cpf-1", "yarn_logs")]


def test_py_strip_matches_python(spark):
    from faultlens.functions.text import PY_WHITESPACE, py_strip
    assert sorted(PY_WHITESPACE) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())
    vals = ["  a b  ", "\t　x \n", "", "\x1cq\x85", "no-space"]
    assert _one(spark, py_strip, vals) == [v.strip() for v in vals]


def test_tokens_match_python_split(spark):
    from faultlens.functions.text import tokens
    vals = ["a  b\tc", " x　y\xa0z ", "\x1cq\x1dr", "", "one"]
    assert _one(spark, tokens, vals) == [v.split() for v in vals]


def test_split_class_is_exactly_isspace(spark):
    from faultlens.functions.text import _SPLIT_RUNS
    chars = [chr(i) for i in range(0x3100)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    splits = {r.c for r in df.where(F.size(F.split(F.concat(F.lit("a"), "c", F.lit("b")), _SPLIT_RUNS)) == 2).collect()}
    assert splits == {c for c in chars if c.isspace()}


def test_mounted_path(spark):
    from faultlens.functions.logs import mounted_path
    rows = [("/hdfs-nfs/tmp/a",), ("/tmp/a",), ("tmp/a",), ("//x",), (None,)]
    df = spark.createDataFrame(rows, "f string")
    assert [r[0] for r in df.select(mounted_path(F.col("f"))).collect()] == [
        "/hdfs-nfs/tmp/a", "/hdfs-nfs/tmp/a", "/hdfs-nfs/tmp/a", "/hdfs-nfs/x", None]
