"""Grouped exact quantiles against numpy, with rounds forced by a small limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators import quantiles
from faultlens.operators.quantiles import grouped_quantiles

FRACTIONS = {"lowest": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "highest": 1.0}


def _check(spark, values, **options):
    rows = [(g, float(x)) for g, xs in values.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r for r in grouped_quantiles(df, ["g"], "x", FRACTIONS, **options).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert got[g].n == len(xs)
        assert np.allclose([got[g][name] for name in FRACTIONS], np.quantile(np.array(xs, float), list(FRACTIONS.values())), rtol=1e-12)


@pytest.mark.parametrize("settle_rows", [1, 40, 100_000])
def test_skewed_tied_and_small_groups(spark, settle_rows):
    draw = np.random.default_rng(3)
    values = {None: draw.normal(size=700), "hot": np.exp(draw.normal(size=4000) * 40), "tied": draw.integers(0, 3, 900),
              "same": [7.0] * 500, "one": [-1.5], "two": [2.0, 1.0], "steps": [*range(300), *[1e300] * 5, *[-1e300] * 4]}
    _check(spark, values, settle_rows=settle_rows)


def test_a_wrong_histogram_costs_rounds_only(spark, monkeypatch):
    """Borders far from the target: the counts lead to the outer regions."""
    whole = quantiles._histogram

    def off(rows, keys):
        got = whole(rows, keys)
        return got.withColumn("_grid", F.reverse("_grid"))
    monkeypatch.setattr(quantiles, "_histogram", off)
    _check(spark, {"a": np.random.default_rng(1).normal(size=600)}, settle_rows=100)


def test_odd_values(spark):
    df = spark.createDataFrame([("n", None), ("m", None), ("m", 4.0), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)], "g string, x double")
    for settle_rows in (1, 100):
        got = {r.g: r for r in grouped_quantiles(df, ["g"], "x", {"p50": 0.5, "top": 1.0}, settle_rows).collect()}
        assert set(got) == {"m", "nan"} and got["m"].n == 1 and got["m"].p50 == got["m"].top == 4.0
        assert got["nan"].p50 == 2.0 and np.isnan(got["nan"].top)
    assert grouped_quantiles(df.limit(0), ["g"], "x", {"p50": 0.5}).count() == 0
    with pytest.raises(ValueError):
        grouped_quantiles(df, ["g"], "x", {"p150": 1.5})
