"""Task-driven collection and the dataset layout, against brute force."""

import os

from faultlens.operators import logs as L
from faultlens.plans import sqlfrag as S
from faultlens.plans.catalog import cte
from faultlens.plans.collect import collect_task_logs, write_dataset
from faultlens.session import scratch_path
from faultlens.sources import fixtures as fx
from tests.harness import duck

SF = "/root/testdata/sf0.001"
TASK = "1700000000000_1006"


def test_collect_task_logs_matches_brute_force(spark):
    got = collect_task_logs(fx.raw_log(spark, SF), TASK).select("event_id", "source").collect()
    sql = cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL, parsed=S.PARSED_SQL) + f"""
    , t AS (SELECT * FROM parsed WHERE contains(filename, '{TASK}') AND contains(filename, 'application_')
            AND task_id IS NOT NULL),
    w AS (SELECT date_trunc('second', min(line_ts) - INTERVAL 3 MINUTE) AS s,
                 date_trunc('second', max(line_ts) + INTERVAL 3 MINUTE) AS e FROM t)
    SELECT event_id, 'component' AS source FROM store, w
    WHERE task_id IS NULL AND component <> 'unknown' AND line_ts >= w.s AND line_ts < w.e
    UNION ALL SELECT event_id, 'task' FROM t"""
    want = duck(SF).sql(sql).fetchall()
    assert sorted((r.event_id, r.source) for r in got) == sorted(want)
    assert any(s == "task" for _, s in want) and any(s == "component" for _, s in want)


def test_write_dataset_layout(spark):
    logs = L.union_logs(fx.raw_log(spark, SF), "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    root = write_dataset(logs, None, scratch_path(spark, "dataset_test"))
    folders = {d for d in os.listdir(root.replace("file:", "") + "/logs") if d.startswith("node=")}
    assert {"node=cpf-1", "node=cpf-2"} <= folders
    kinds = {d for n in folders for d in os.listdir(root.replace("file:", "") + "/logs/" + n)}
    assert "log_file=datanode" in kinds and any(k.startswith("log_file=task_") for k in kinds)


def test_read_log_files_uses_real_paths(spark, tmp_path):
    from faultlens.sources.files import read_log_files
    d = tmp_path / "hdfs-nfs" / "application_17_0002"
    d.mkdir(parents=True)
    (d / "cpf-3_45454").write_text("2024-01-05 10:20:30,123 INFO a\n  at frame\n2024-01-05 10:20:31 WARN b\n")
    (tmp_path / "yarn-nodemanager-cpf-2.log").write_text("2024-01-05 10:00:00,001 ERROR c\n")
    raw = read_log_files(spark, str(tmp_path))
    recs = L.parse_lines(raw, keep=("filename",)).collect()
    got = sorted((r.node, r.task_id, r.component, r.level) for r in recs)
    assert got == [("cpf-2", None, "nodemanager", "ERROR"), ("cpf-3", "17_0002", "mapreduce", "INFO"),
                   ("cpf-3", "17_0002", "mapreduce", "WARN")]
    missing = read_log_files(spark, [str(tmp_path / "yarn-nodemanager-cpf-2.log"), str(tmp_path / "gone.log")])
    assert missing.count() == 1


def test_collect_recent_and_store_task_source(spark):
    from pyspark.sql import functions as F

    from faultlens.plans.collect import collect_logs, collect_recent
    raw = fx.raw_log(spark, SF)
    newest = raw.agg(F.max("ts")).first()[0]
    recent = collect_recent(raw, 600)
    comp = recent.where(F.col("source") == "component").select("event_id").collect()
    con = duck(SF)
    want = con.sql(cte(raw_log=fx.RAW_LOG_SQL, store=S.STORE_SQL) + f"""
        SELECT event_id FROM store WHERE task_id IS NULL AND component <> 'unknown'
        AND line_ts > TIMESTAMP '{newest}' - INTERVAL 600 MINUTE""").fetchall()
    assert sorted(r.event_id for r in comp) == sorted(w[0] for w in want)
    via_store = collect_logs(raw, "2024-01-01 00:00:00", "2024-02-01 00:00:00", task_source="store")
    tasks = via_store.where(F.col("source") == "task")
    # every stored task-file row comes back (unparsed lines included), level from the store label
    assert tasks.count() == raw.where(F.col("filename").contains("application_")).count()


def test_invalid_utf8_bytes_are_dropped(spark, tmp_path):
    from faultlens.sources.files import read_log_files
    raw = b"2024-01-05 10:20:30 INFO ok\xff\xfe bytes\n2024-01-05 10:20:31 WARN caf\xc3\xa9\n"
    (tmp_path / "x.log").write_bytes(raw)
    got = sorted(r.line for r in read_log_files(spark, str(tmp_path)).collect())
    assert got == sorted(raw.decode("utf-8", errors="ignore").splitlines())


def test_summary_report_per_run(spark):
    import glob

    from faultlens.plans.catalog import QUERIES, load_all
    from faultlens.plans.collect import write_summary_report
    load_all()
    summary = QUERIES["collection_summary"](spark, SF)
    root = write_summary_report(summary, scratch_path(spark, "report_test"))
    folders = glob.glob(root.replace("file:", "") + "/run_id=*")
    assert len(folders) == summary.count() > 0
    text = open(glob.glob(folders[0] + "/part-*")[0]).read()
    assert text.startswith("run: ") and "log rows: " in text and "window: " in text


def test_collect_metrics_prunes_categories_and_writes_layout(spark):
    import os

    from faultlens.plans.collect import collect_metrics, write_dataset
    body = ('{"status":"success","data":{"resultType":"matrix","result":['
            '{"metric":{"instance":"cpf-2:9100","device":"sda"},"values":[[1704067207,"5"],[1704067222,"6"]]}]}}')
    pages = spark.createDataFrame([("node_disk_read_bytes_total", body), ("node_load1", body)], "query string, body string")
    kept = collect_metrics(pages)                       # default categories: cpu, memory
    assert sorted({r.metric for r in kept.collect()}) == ["node_load1"]
    assert collect_metrics(pages, ["disk"]).count() == 2
    logs = L.union_logs(fx.raw_log(spark, SF), "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    root = write_dataset(logs, kept, scratch_path(spark, "dataset_metrics"))
    base = root.replace("file:", "")
    assert os.listdir(base + "/metrics") and any(d.startswith("hostname=cpf-2") for d in os.listdir(base + "/metrics"))
