"""Exact percentiles by narrow ranges, and matches among equal values."""

import numpy as np
from pyspark.sql import functions as F

from infocausal.operators import bounds, effects, quantiles, scm

AT = [0.0, 0.05, 0.1, 0.5, 0.9, 1.0]


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = {0: rng.normal(size=4001), 1: np.r_[np.zeros(3000), rng.normal(size=1001)], 2: np.array([1.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [(0, None), (3, None)], "g int, v double")
    for accuracy in (10_000, 5):  # with the second, sketches are off and ranges grow
        got = quantiles.percentiles(df, "g", "v", AT, accuracy)
        assert sorted(got) == [0, 1, 2]
        for g, vs in values.items():
            assert np.allclose(got[g], np.quantile(vs, AT), atol=1e-12), (g, accuracy)


def test_no_task_gathers_the_values(spark):
    """Percentile aggregates keep a map of all distinct values in one task."""
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("t"), F.col("id").cast("double").alias("y"))
    model = scm.linear(y={"1": 0.0})
    for d in (bounds.quantile_effects(df, [0.5]), scm.worlds(model, df, "y", {"same": {}})):
        assert "percentile(" not in d._jdf.queryExecution().optimizedPlan().toString()
    r = bounds.quantile_effects(df, [0.5]).first()
    assert (r["y1"], r["y0"], r["effect"]) == (500.0, 499.0, 1.0)
    assert [r["y0"] for r in bounds.quantile_effects(df.filter("t = 1"), [0.5]).collect()] == [None]


def test_nearest_match_of_equal_values(spark):
    """At the row's own value or below the control with the largest key counts, above it that with the smallest, in any range."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.5), float(rng.integers(100)), float(rng.integers(60)), k) for k in range(300)]
    df = spark.createDataFrame(rows, "t int, y double, x double, k long")
    controls = [r for r in rows if r[0] == 0]
    gaps = []
    for _, y, x, _ in (r for r in rows if r[0] == 1):
        mx = min((abs(c[2] - x), c[2]) for c in controls)[1]
        gaps.append(y - (max if mx <= x else min)((c[3], c[1]) for c in controls if c[2] == mx)[1])
    for per_cell in (100_000, 7):
        got = effects.nearest_match(df, "x", "k", per_cell).first()
        assert abs(got["att"] - np.mean(gaps)) < 1e-9 and got["n1"] == len(gaps)
