"""The user's run files: plans, results and CSV trees with headers of their own."""

import json

from faultlens.operators import runs as ops
from faultlens.sources import runfiles as RF

PLAN = {"faults": [{"type": "a", "count": 2, "order": 2, "enabled": True, "description": "d",
                    "params": {"minutes_before": 9}},
                   {"type": "b", "count": 1}, {"type": "c", "count": 3, "order": 1, "enabled": False}, {"type": "e", "count": 0, "order": 1}],
        "global_settings": {"output_dir": "/o", "random_order": False, "interval_between_faults": 5}}


def test_plan_file_of_many_lines(spark, tmp_path):
    (tmp_path / "plan a.json").write_text(json.dumps(PLAN, indent=4))
    plans = RF.read_plans(spark, str(tmp_path / "plan a.json"))
    rows = ops.expand_plans(RF.plan_entries(plans)).orderBy("k").collect()
    assert [(r.k, r.total, r.fault_type, r.i, r.order_key, r.minutes_before, r.minutes_after, r.description) for r in rows] == [
        (1, 3, "a", 1, 2, 9, 5, "d"), (2, 3, "a", 2, 2, 9, 5, "d"), (3, 3, "b", 1, 999, 3, 5, None)]
    assert rows[0].plan == str(tmp_path / "plan a.json")


def test_default_plan(spark):
    rows = ops.expand_plans(RF.plan_entries(RF.default_plan(spark))).orderBy("k").collect()
    assert [r.fault_type for r in rows] == ["data_bloat"] * 2 + ["task_fail"] * 2 + ["data_skew"] * 2


def test_random_order_is_fixed_by_the_seed(spark, tmp_path):
    plan = dict(PLAN, global_settings={"random_order": True}, faults=[{"type": str(k), "count": 1} for k in range(20)])
    (tmp_path / "p.json").write_text(json.dumps(plan))
    entries = RF.plan_entries(RF.read_plans(spark, str(tmp_path / "p.json")))
    first, again, other = ([r.fault_type for r in ops.expand_plans(entries, s).orderBy("k").collect()] for s in (1, 1, 2))
    assert first == again != other and sorted(first) == sorted(other) != first


def test_results_with_and_without_fields(spark, tmp_path):
    lines = [{"fault_type": "a", "job_id": "job_1_2", "success": True, "affected_nodes": ["n"], "timestamp": "2024-01-01T00:00:01"},
             {"fault_type": "a", "success": False, "error": "x", "timestamp": "2024-01-01T00:00:00"}, {"fault_type": "b"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.fault_type: (r.total_runs, r.successful_runs, r.failed_runs)
           for r in ops.outcome_counts(RF.read_results(spark, str(tmp_path / "r.json"))).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 1), None: (3, 1, 2)}


def test_csv_by_header_at_any_depth(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "one.csv").write_text('message,hostname,extra\n"a, ""b""\nc",h1,1\nmessage,h2,2\n')
    (tmp_path / "x" / "two.csv").write_text("log_type,message\nt,m2\n,m3\n")
    (tmp_path / "x" / "y" / "empty.csv").write_text("message,log_type\n")
    (tmp_path / "x" / "no.txt").write_text("message\nzzz\n")
    rows = RF.read_csv_by_header(spark, str(tmp_path), {"message": "", "hostname": "unknown", "log_type": "unknown"}).collect()
    got = {(r.message, r.hostname, r.log_type or "") for r in rows}
    assert len(rows) == 4 and got == {('a, "b"\nc', "h1", "unknown"), ("message", "h2", "unknown"), ("m2", "unknown", "t"),
                                      ("m3", "unknown", "")}


def test_catalogue_of_the_users_own(spark):
    from faultlens.plans import dims
    own = spark.createDataFrame([("z", "mine", ["n9"], ["s"], "by hand", True)], dims.FAULT_SCHEMA)
    runs = spark.createDataFrame([("r1", "z", None), ("r2", "q", "/s/inject_z.sh")], "run_id string, fault_type string, script string")
    got = {r.run_id: (r.description, r.nodes_known) for r in ops.with_fault_info(runs.drop("script"), own).collect()}
    assert got == {"r1": ("mine", True), "r2": (dims.UNKNOWN_FAULT[0], False)}
    by_script = ops.with_fault_info(runs.where("script is not null"), own).first()
    assert by_script.description == "mine"
    assert [r.run_id for r in ops.known_nodes(ops.with_fault_info(runs.drop("script"), own)).collect()] == ["r1"]


def test_equal_plans_stay_apart(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join([json.dumps(PLAN), "", json.dumps(PLAN)]) + "\n")
    plans = RF.read_plans(spark, str(tmp_path / "p.json"), multi_line=False)
    rows = ops.expand_plans(RF.plan_entries(plans)).collect()
    assert len({r.plan for r in rows}) == 2 and all(r.plan.startswith(str(tmp_path / "p.json")) for r in rows)
    assert sorted((r.k, r.total, r.fault_type) for r in rows) == sorted(2 * [(1, 3, "a"), (2, 3, "a"), (3, 3, "b")])


WANTED = {"message": "", "node": "unknown", "level": "unknown"}


def read_csv(spark, path, **options):
    return sorted((r.file.rsplit("/", 1)[-1], r.message, r.node, r.level)
                  for r in RF.read_csv_by_header(spark, str(path), WANTED, **options).collect())


def test_csv_without_a_known_name(spark, tmp_path):
    (tmp_path / "none.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "some.csv").write_text("message\nm\n")
    assert read_csv(spark, tmp_path) == [("none.csv", "", "unknown", "unknown")] * 2 + [("some.csv", "m", "unknown", "unknown")]


def test_csv_of_many_columns(spark, tmp_path):
    names = [f"x{k}" for k in range(70)] + ["node", "level"] + [f"y{k}" for k in range(90)] + ["message"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(f"v{k}" for k in range(len(names))) + "\n")
    assert read_csv(spark, tmp_path) == [("wide.csv", "v162", "v70", "v71")]
    assert read_csv(spark, tmp_path, width=2) == [("wide.csv", "v162", "v70", "v71")]


def test_csv_header_is_the_first_record(spark, tmp_path):
    (tmp_path / "h.csv").write_text("level,node,z\nnode,level,zz\nlevel,node,z\nlevel,node,z\nl,n\n")
    (tmp_path / "twice.csv").write_text("node,message,node\na,b,c\n")
    assert read_csv(spark, tmp_path) == sorted([
        ("h.csv", "", "level", "node"), ("h.csv", "", "node", "level"), ("h.csv", "", "node", "level"), ("h.csv", "", "n", "l"),
        ("twice.csv", "b", "c", "unknown")])
