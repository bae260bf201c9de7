"""Sinks are lossless: awkward text survives the partitioned CSV round trip."""

from pyspark.sql import types as T

from faultlens.session import scratch_path
from faultlens.sinks.files import (read_json_lines, read_key_value_text, read_partitioned_csv, write_json_lines,
                                   write_key_value_text, write_partitioned_csv)

AWKWARD = ['say "hi"', "back\\slash", "multi\nline\r\nmessage", "  leading and trailing  ", "", None,
           'comma, "quoted", \\"escaped\\"', "tab\tinside", "\\N literal"]


def test_csv_round_trip_is_lossless(spark):
    rows = [(i, f"cpf-{i % 2}", m) for i, m in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "id long, node string, message string")
    path = scratch_path(spark, "sink_test")
    write_partitioned_csv(df, path, ["node"], ["id"], salt_source="id")
    back = read_partitioned_csv(spark, path, T.StructType([T.StructField("id", T.LongType()),
                                                           T.StructField("message", T.StringType())]), ["node"])
    got = {r.id: r.message for r in back.collect()}
    assert got == dict(enumerate(AWKWARD))
    assert got[4] == "" and got[5] is None


def test_folder_names_come_back_as_they_were(spark):
    values = ["007", "1", "2024-01-01", "", None, "__empty__", "__empty__x", "a/b=c", "x y%z", "true"]
    rows = [(i, v, f"m{i}") for i, v in enumerate(values * 3)]
    path = scratch_path(spark, "folder_test")
    write_partitioned_csv(spark.createDataFrame(rows, "id long, host string, message string"), path, ["host"], ["id"],
                          salt_source="id", rows_per_writer=2)
    back = read_partitioned_csv(spark, path, T.StructType([T.StructField("id", T.LongType()),
                                                           T.StructField("message", T.StringType())]), ["host"])
    assert sorted((r.id, r.host, r.message) for r in back.collect()) == rows


def test_log_files_keep_real_paths_and_text(spark, tmp_path):
    from faultlens.sources.files import read_log_files, read_log_tree, write_log_tree
    folder = tmp_path / "logs a+b%20c"
    folder.mkdir()
    (folder / "x.log").write_bytes(b"one\nb\xff\xfead \xef\xbf\xbd kept\n")
    got = sorted((r.filename, r.line) for r in read_log_files(spark, str(folder)).collect())
    assert got == [(str(folder / "x.log"), "bad \ufffd kept"), (str(folder / "x.log"), "one")]
    lines = spark.createDataFrame([(i, "/var/x", "same line") for i in range(10)], "event_id long, filename string, line string")
    root = write_log_tree(lines, scratch_path(spark, "tree_test"), key_col="event_id", rows_per_writer=2)
    assert read_log_tree(spark, root).groupBy("filename", "line").count().collect()[0]["count"] == 10


def test_json_and_text_round_trips(spark):
    df = spark.createDataFrame([("a", 1, None), ("b\tc", 2, "x")], "k string, n long, opt string")
    p = scratch_path(spark, "json_test")
    write_json_lines(df, p)
    assert sorted(read_json_lines(spark, p, df.schema).collect()) == sorted(df.collect())
    p2 = scratch_path(spark, "text_test")
    kv = spark.createDataFrame([("w1", 3), ("w2", 5)], "word string, n long")
    write_key_value_text(kv, p2, "word", "n")
    assert sorted(read_key_value_text(spark, p2, "word", "n").collect()) == sorted(kv.collect())


def test_scratch_is_removed_by_name(spark):
    from faultlens.session import clean_scratch
    path = scratch_path(spark, "clean_test")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert clean_scratch(spark, "clean_test") and not clean_scratch(spark, "clean_test")


def test_cluster_needs_a_shared_folder():
    import types

    import pytest

    from faultlens.session import shared_dir
    nothing = types.SimpleNamespace(get=lambda key, default=None: default)
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(types.SimpleNamespace(conf=nothing, sparkContext=context))
