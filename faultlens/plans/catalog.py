"""Registry of named queries: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL.

Query modules register themselves with :func:`register`; ``load_all`` imports them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
NOTES: dict[str, str] = {}

_MODULES = [
    "faultlens.plans.mapreduce_jobs",
    "faultlens.plans.log_jobs",
    "faultlens.plans.metric_jobs",
    "faultlens.plans.run_jobs",
    "faultlens.plans.detect_jobs",
    "faultlens.plans.sink_jobs",
    "faultlens.plans.stream_jobs",
    "faultlens.plans.rough_jobs",
    "faultlens.plans.analysis_jobs",
]


def register(name: str, oracle: str | None = None, note: str | None = None):
    """Decorator registering a query under ``name`` with its optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if note:
            NOTES[name] = note
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that the registry is complete."""
    for m in _MODULES:
        importlib.import_module(m)


def cte(**parts: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle SQL."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"
