"""Exact quantiles of many groups at once, by selection in rounds instead of a sort of each group.

A quantile lies between the values at two places of its group's order. Each such place is a target. In a round the rows that a
target may still be among give a histogram of equal depth (``percentile_approx`` on a fixed grid, combined map-side); two of its
borders around the target's place cut the rows into three regions and two border values, whose rows are counted exactly. The
target is a border value or goes on into one region. The counts alone decide, so a rough histogram costs a round, never the
result. Regions of at most ``settle_rows`` rows are finished by a window; no task ever sorts more of a group than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.ordering import join_null_safe, materialize_observed, materialize_sized, maybe_broadcast

#: Rows of a target that a window may sort.
SETTLE_ROWS = 200_000
#: Cells of a round's histogram, and the accuracy of its borders.
CELLS, ACCURACY = 32, 500
_TARGET = ["_k"]


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _min, _max, _grid)``: borders of cells of about equal numbers of rows."""
    grid = F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], ACCURACY)
    return rows.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), grid.alias("_grid"))


def _borders(targets: DataFrame) -> DataFrame:
    """``_lo``, ``_hi``: the borders one cell before and one behind the cell that holds the target's place."""
    cell = F.floor(F.col("_place") * CELLS / F.col("_n")).cast("int")
    low = F.when(cell < 2, F.col("_min")).otherwise(F.element_at("_grid", F.greatest(cell - 1, F.lit(1))))
    high = F.when(cell > CELLS - 3, F.col("_max")).otherwise(F.element_at("_grid", F.least(cell + 2, F.lit(CELLS - 1))))
    return targets.withColumns({"_lo": F.least(low, high), "_hi": F.greatest(low, high)}).drop("_min", "_max", "_grid")


def _round(rows: DataFrame, targets: DataFrame, groups: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame, dict]:
    """One round: ``(targets, rows, what was seen)``, the rows of each target's region and the targets with ``_found`` or a new place."""
    bounds, seen = materialize_sized(_borders(join_null_safe(targets, _histogram(rows, keys), keys)))
    small = maybe_broadcast(bounds, rows=seen["rows"], size=seen["bytes"])
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    area = F.when(v < lo, 0).when(v == lo, 1).when(v < hi, 2).when(v == hi, 3).otherwise(4)
    met = join_null_safe(rows, small, keys).withColumn("_area", area)
    sizes = met.groupBy(*groups, *_TARGET).agg(*[F.count_if(F.col("_area") == a).alias(f"_a{a}") for a in range(5)])
    after = [sum((F.col(f"_a{b}") for b in range(1, a + 1)), F.col("_a0")) for a in range(5)]
    chosen = F.lit(4)
    for a in reversed(range(4)):
        chosen = F.when(F.col("_place") < after[a], a).otherwise(chosen)
    stepped = join_null_safe(bounds, sizes, [*groups, *_TARGET]).withColumn("_chosen", chosen)
    place, count = F.col("_place"), F.lit(0).cast("long")
    for a in (0, 2, 4):
        inside = F.col("_chosen") == a
        place = F.when(inside, F.col("_place") - (after[a - 1] if a else F.lit(0))).otherwise(place)
        count = F.when(inside, F.col(f"_a{a}")).otherwise(count)
    stepped = stepped.select(*groups, *_TARGET, "_lo", "_hi", "_chosen", place.alias("_place"), count.alias("_n"),
                             F.when(F.col("_chosen") == 1, lo).when(F.col("_chosen") == 3, hi).alias("_found"))
    stepped, told = materialize_sized(stepped, most=F.max("_n"))
    # the rows of the regions that are gone on with, for each target its own
    open_ = maybe_broadcast(stepped.where("_found IS NULL").select(*groups, *_TARGET, "_lo", "_hi", "_chosen"),
                            rows=told["rows"], size=told["bytes"])
    left = join_null_safe(rows, open_, keys).where(area == F.col("_chosen")).select(*groups, *_TARGET, "_v")
    return stepped.select(*groups, *_TARGET, "_place", "_n", "_found"), left, told


def grouped_quantiles(df: DataFrame, group_cols: list[str], value_col: str, fractions: dict[str, float],
                      settle_rows: int = SETTLE_ROWS) -> DataFrame:
    """``(group, n, <names>)``: exact quantiles of each group, interpolated between neighbouring values.

    ``fractions`` maps names to fractions from 0 to 1; the quantile is at place ``fraction * (n - 1)`` of the group's n values in
    order, counted from 0. Values are doubles; NULL ones take no part (a group of NULLs alone gives no row), NaN is the greatest.
    NULL groups are a group of their own; an empty table gives no rows.
    """
    if not all(0 <= f <= 1 for f in fractions.values()):
        raise ValueError("fractions lie between 0 and 1")
    rows = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where("_v IS NOT NULL")
    sizes, _ = materialize_observed(rows.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")))
    at = [F.floor(F.lit(f) * (F.col("_n") - 1)).cast("long") for f in fractions.values()]
    places = F.array_distinct(F.array(*at, *[F.least(a + 1, F.col("_n") - 1) for a in at]))
    targets, seen = materialize_sized(sizes.select(*group_cols, "_n", F.explode(places).alias("_k")).withColumn("_place", F.col("_k")),
                                      most=F.max("_n"))
    keys, values = list(group_cols), []
    while seen["rows"] and (seen["most"] or 0) > settle_rows:
        # targets few enough to sort leave before the round, with their rows
        ready = targets.where(F.col("_n") <= settle_rows)
        values.append(_sorted(rows, ready, group_cols, keys))
        targets, rows, seen = _round(rows, targets.where(F.col("_n") > settle_rows), group_cols, keys)
        keys = [*group_cols, *_TARGET]
        rows, _ = materialize_observed(rows)
        values.append(targets.where("_found IS NOT NULL").select(*group_cols, *_TARGET, F.col("_found").alias("_v")))
        targets = targets.where("_found IS NULL").drop("_found")
    values.append(_sorted(rows, targets, group_cols, keys))
    found = values[0]
    for more in values[1:]:
        found = found.unionByName(more)
    # at most two values for each fraction of a group
    held = found.groupBy(*group_cols).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"))

    def quantile(fraction: float):
        exact = F.lit(fraction) * (F.col("_n") - 1)
        low = F.floor(exact).cast("long")
        below, above = F.element_at("_at", low), F.element_at("_at", F.least(low + 1, F.col("_n") - 1))
        share = exact - low
        return F.when((share == 0) | (below == above), below).otherwise(below + (above - below) * share)

    return join_null_safe(sizes, held, group_cols).select(
        *group_cols, F.col("_n").alias("n"), *[quantile(f).alias(name) for name, f in fractions.items()])


def _sorted(rows: DataFrame, targets: DataFrame, group_cols: list[str], keys: list[str]) -> DataFrame:
    """``(group, _k, _v)`` of targets whose rows are few: numbered in order, once for each key."""
    order = Window.partitionBy(*keys).orderBy("_v")
    wanted = targets.select(*group_cols, *_TARGET, "_place")
    # measured, so that rows of larger groups are mostly dropped where they lie
    some = maybe_broadcast(targets.select(*keys).distinct())
    own = join_null_safe(rows, some, keys).withColumn("_place", F.row_number().over(order).cast("long") - 1)
    return join_null_safe(own, wanted, [*keys, "_place"]).select(*group_cols, *_TARGET, "_v")
