"""Scale properties of the physical plans (what the operators promise in README)."""

import pytest

from faultlens.plans.catalog import QUERIES, load_all
from tools.plan_summary import summarise

load_all()
SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = QUERIES[name](spark, SF)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_nested_loops(spark, name):
    s = summarise(_plan(spark, name))
    assert s["python"] == 0 and s["nlj"] == 0


def test_wordcount_partial_aggregation(spark):
    plan = _plan(spark, "wordcount")
    assert "partial_count" in plan


def test_topn_limits_before_shuffle(spark):
    plan = _plan(spark, "log_topn_per_file")
    assert "WindowGroupLimit" in plan and ", Partial" in plan and ", Final" in plan


def test_time_range_pushed_to_scan(spark):
    plan = _plan(spark, "log_time_filter")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("name", ["metric_instant", "metric_rate", "metric_increase", "labelled_records", "labelled_metrics",
                                  "collection_summary"])
def test_time_bounds_reach_the_scan(spark, name):
    """Literal bounds on the stored time, also behind an exchange that materialised windows feed."""
    plan = _plan(spark, name)
    if "Scan parquet" in plan:
        assert "PushedFilters: [IsNotNull(ts), LessThan" in plan or "GreaterThan" in plan.split("PushedFilters", 1)[1][:200]


def test_grid_aggregates_are_hash_aggregates(spark):
    for name in ("metric_instant", "metric_rate"):
        assert "SortAggregate" not in _plan(spark, name)


def test_range_join_is_hash_join(spark):
    for name in ("task_window_logs", "labelled_records"):
        s = summarise(_plan(spark, name))
        assert s["bhj"] + s["smj"] + s["shj"] >= 1 and s["nlj"] == 0


def test_response_lines_round_trip(spark):
    from faultlens.operators.logs import flatten_log_responses
    from faultlens.session import scratch_path
    from faultlens.sources import fixtures as fx
    from faultlens.sources.logstore import log_responses, read_response_lines
    path = scratch_path(spark, "responses_test")
    pages = log_responses(fx.raw_log(spark, SF))
    pages.select("body").write.text(path)
    direct = flatten_log_responses(pages).count()
    assert flatten_log_responses(read_response_lines(spark, path)).count() == direct > 0
