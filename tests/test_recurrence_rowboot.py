"""Neighbours in delay space, row bootstrap, fitted models and refutations against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infocausal.operators import recurrence, refute, rowboot, scm


def long(spark, **series):
    return spark.createDataFrame([(s, t, float(v)) for s, a in series.items() for t, v in enumerate(a)], "series string, t long, v double")


def henon(n, skip=100):
    x, y, out = 0.1, 0.3, []
    for i in range(n + skip):
        x, y = 1 - 1.4 * x * x + y, 0.3 * x
        if i >= skip:
            out.append(x)
    return np.array(out)


def test_delays_skip_gaps(spark):
    df = long(spark, a=range(6)).filter("t != 2")
    got = sorted((r["t"], r["x0"], r["x1"]) for r in recurrence.delays(df, {"x0": 0, "x1": -1}).collect())
    assert got == [(1, 1.0, 0.0), (4, 4.0, 3.0), (5, 5.0, 4.0)]


@pytest.mark.parametrize("exclude", [0, 3])
def test_nearest_equals_all_pairs(spark, exclude):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=120), [50.0, -80.0], np.zeros(6)])
    p = recurrence.delays(long(spark, a=v, b=rng.integers(0, 4, 60)), {"x0": 0, "x1": -1})
    rows = {(r["series"], r["t"]): (r["x0"], r["x1"]) for r in p.collect()}
    got = {(r["series"], r["t"]): (r["d"], r["t2"]) for r in recurrence.nearest(p, ["x0", "x1"], exclude).collect()}
    want = {}
    for (s, t), a in rows.items():
        want[s, t] = min((max(abs(a[0] - b[0]), abs(a[1] - b[1])), u) for (q, u), b in rows.items() if q == s and abs(t - u) > exclude)
    assert got == want


def test_two_delays_unfold_henon(spark):
    scan = recurrence.embedding_scan(long(spark, h=henon(600)), (1, 2, 3))
    r = {x["m"]: x for x in scan.collect()}
    assert r[1]["false_share"] > 0.3 > 0.1 > r[2]["false_share"] and r[2]["error"] < r[1]["error"] / 3
    best = recurrence.best_embedding(scan).first()
    assert best["by_neighbours"] == 2 and best["by_prediction"] in (2, 3)


def test_one_point_has_no_neighbour(spark):
    p = recurrence.delays(long(spark, a=[1.0]), {"x0": 0})
    assert recurrence.nearest(p, ["x0"]).count() == 0 and recurrence.nearest(p.filter("t > 5"), ["x0"]).count() == 0


def test_serial_dependence(spark):
    rng = np.random.default_rng(2)
    noise = {f"n{i}": rng.normal(size=400) for i in range(12)}
    r = {x["series"]: x["statistic"] for x in recurrence.serial_dependence(long(spark, h=henon(400), **noise)).collect()}
    own = np.array([v for s, v in r.items() if s != "h"])
    assert r["h"] > 10 and abs(own.mean()) < 1 and 0.4 < own.std() < 2


def test_correlation_transfer_has_a_direction(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = np.concatenate([[0.0], 0.9 * x[:-1]]) + 0.3 * rng.normal(size=500)
    te = {(r["source"], r["target"]): r["te"] for r in recurrence.correlation_transfer(long(spark, x=x, y=y)).collect()}
    assert te["x", "y"] > 0.2 > te["y", "x"] + 0.1


def arms(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 3, n)
    t = (rng.random(n) < 0.2 + 0.2 * z).astype(int)
    y = 2 * t + 3 * z + rng.normal(size=n)
    return spark.createDataFrame([(i, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(z, t, y, strict=True))], "i long, z int, t int, y double"), z, t, y


def test_errors_of_effects(spark):
    df, z, t, y = arms(spark)
    r = {x["estimator"]: x for x in rowboot.effect_errors(df, ["i"], 100).collect()}
    welch = np.sqrt(y[t == 1].var(ddof=1) / (t == 1).sum() + y[t == 0].var(ddof=1) / (t == 0).sum())
    assert r["naive"]["se"] == pytest.approx(welch, rel=0.25) and r["naive"]["estimate"] > 3
    for name in ("stratified", "weighted", "treated"):
        assert r[name]["estimate"] == pytest.approx(2, abs=0.12) and r[name]["low"] < 2 < r[name]["high"] and r[name]["replicates"] == 100


def test_draws_are_poisson(spark):
    df, *_ = arms(spark, 2000)
    w = rowboot.weighted_rows(df, ["i"], 6)
    by = w.groupBy("rep").agg(F.sum("w").alias("n"), F.count("*").alias("k"), F.max("w").alias("m")).collect()
    assert len(by) == 6 and all(abs(r["n"] - 2000) < 200 and abs(r["k"] / 2000 - 0.632) < 0.05 and 3 < r["m"] <= 6 for r in by)


@pytest.mark.parametrize("held", [4096, 2])
def test_sums_equal_weighted_rows(spark, monkeypatch, held):
    """The sums used to take a row for each row and replicate through Spark's aggregation."""
    monkeypatch.setattr(rowboot, "HELD", held)
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", i % 2, i * 0.25) for i in range(60)] + [(99, "alone", 1, 5.0)]
    df = spark.createDataFrame(rows, "i long, z string, t int, y double")
    want = rowboot.weighted_rows(df, ["i"], 6).groupBy("z", "t", "rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
    got = rowboot.weighted_sums(df, ["i"], 6, ["z", "t"], {"s": F.col("y")})
    as_set = lambda d: {(r["z"], r["t"], r["rep"], float(r["n"]), r["s"]) for r in d.collect()}
    assert as_set(got) == as_set(want) and got.columns == want.columns
    assert rowboot.weighted_sums(df.filter("i < 0"), ["i"], 6, [], {"s": F.col("y")}).count() == 0


def test_errors_of_mediation(spark):
    rng = np.random.default_rng(5)
    t = (rng.random(2000) < 0.5).astype(float)
    m = 0.8 * t + rng.normal(size=2000)
    y = 0.5 * t + 0.7 * m + rng.normal(size=2000)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(t, m, y, strict=True))], "i long, t double, m double, y double")
    r = {x["estimator"]: x for x in rowboot.moment_errors(df, ["t", "m", "y"], ["i"], rowboot.mediated, 80).collect()}
    assert r["indirect"]["low"] < 0.56 < r["indirect"]["high"] and r["total"]["estimate"] == pytest.approx(r["direct"]["estimate"] + r["indirect"]["estimate"])
    assert r["indirect"]["se"] == pytest.approx(0.04, rel=0.5)


def test_fitted_model_and_worlds(spark):
    df, z, t, y = arms(spark)
    model = scm.fitted(df, {"z": [], "t": ["z"], "y": ["z", "t"]})
    r = {x["world"]: x for x in scm.worlds(model, df, "y", {"same": {}, "none": {"t": 0.0}, "all": {"t": 1.0}}, F.col("t") == 1).collect()}
    assert r["same"]["change"] == pytest.approx(0, abs=1e-9) and r["all"]["change"] == pytest.approx(0, abs=1e-9)
    assert r["none"]["change"] == pytest.approx(-2, abs=0.15) and r["none"]["better"] == 0.0 and r["none"]["n"] == int((t == 1).sum())


def test_refutations(spark):
    df, *_ = arms(spark)
    r = {x["test"]: x["stratified"] for x in refute.refutations(df, ["i"]).collect()}
    assert abs(r["placebo"]) < 0.15 and all(abs(r[k] - 2) < 0.15 for k in ("none", "random cause", "part"))


def test_compliance(spark):
    rng = np.random.default_rng(6)
    z, u = (rng.random(4000) < 0.5).astype(int), rng.random(4000)
    t = ((u < 0.2) | ((u < 0.7) & (z == 1))).astype(int)  # a fifth always, half comply
    y = 1.5 * t + 2 * u + 0.1 * rng.normal(size=4000)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(z, t, y, strict=True)], "z int, t int, y double")
    r = refute.compliance(df, "z", "t", "y").first()
    assert r["compliers"] == pytest.approx(1.5, abs=0.15) and r["uptake"] == pytest.approx(0.5, abs=0.05) and not r["one_sided"] and abs(r["as_treated"] - 1.5) > 0.3
