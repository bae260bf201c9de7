"""Metric label expressions: instance -> host/service, metric name and category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: metric-name category rules, tried in order --------------------
CATEGORY_RULES = [
    ("cpu", ["cpu", "load"]),
    ("memory", ["memory", "swap", "buffer", "cache"]),
    ("disk", ["disk", "filesystem", "io_"]),
    ("network", ["network"]),
]
OTHER_CATEGORY = "other"
# -------------------------------------------------------------------------------


def literal_map(mapping: dict) -> Column:
    """A constant MAP literal: lookups stay inside the projection, no join."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def host_from_instance(instance: Column, instance_hosts: dict) -> Column:
    """Known instance -> host; else text before ':'; blank -> unknown."""
    known = F.element_at(literal_map(instance_hosts), instance)
    return (F.when(instance.isNull() | (instance == ""), F.lit("unknown"))
            .otherwise(F.coalesce(known, F.split_part(instance, F.lit(":"), F.lit(1)))))


def service_from_instance(instance: Column, service_ports: dict) -> Column:
    """Port -> service name; unlisted port -> ``port_<p>``; no port -> unknown."""
    port = F.split_part(instance, F.lit(":"), F.lit(2))
    named = F.element_at(literal_map(service_ports), port)
    return (F.when(instance.isNull() | (instance == "") | ~instance.contains(":"), F.lit("unknown"))
            .otherwise(F.coalesce(named, F.concat(F.lit("port_"), port))))


def metric_name(query: Column) -> Column:
    """Metric name of a query: the text before the first ``{``."""
    return F.split_part(query, F.lit("{"), F.lit(1))


def metric_category(name: Column) -> Column:
    """Category of a metric name by the ordered substring rules."""
    expr = None
    for category, words in CATEGORY_RULES:
        cond = None
        for w in words:
            c = name.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(OTHER_CATEGORY))


def label(labels: Column, key: str) -> Column:
    """A label from the series map, ``''`` when absent."""
    return F.coalesce(F.element_at(labels, F.lit(key)), F.lit(""))
