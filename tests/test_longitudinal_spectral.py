"""Step-wise treatments, spectra and densities against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infocausal.operators import longitudinal, spectral


def simulated(n=20000, seed=1):
    """l2 is changed by a1 and changes a2 and y, so that neither regression on a1, a2 nor on l2 as well is right; E y under a plan is known."""
    rng = np.random.default_rng(seed)
    u = rng.random(n) < 0.5
    l1 = (rng.random(n) < 0.3 + 0.4 * u).astype(int)
    a1 = (rng.random(n) < 0.3 + 0.4 * l1).astype(int)
    l2 = (rng.random(n) < 0.2 + 0.3 * u + 0.3 * a1).astype(int)
    a2 = (rng.random(n) < 0.2 + 0.5 * l2).astype(int)
    y = 1.0 * a1 + 2.0 * a2 + 3.0 * u + rng.normal(size=n)
    return l1, a1, l2, a2, y


def test_plans(spark):
    cols = simulated()
    df = spark.createDataFrame([(i, *map(int, r[:4]), float(r[4])) for i, r in enumerate(zip(*cols, strict=True))], "i long, l1 int, a1 int, l2 int, a2 int, y double")
    want = {(0, 0): 1.5, (1, 0): 2.5, (0, 1): 3.5, (1, 1): 4.5}
    for plan, mean in want.items():
        g, w = longitudinal.plan_mean(df, plan).first(), longitudinal.plan_weighted(df, plan).first()
        assert g["mean"] == pytest.approx(mean, abs=0.15) and g["covered"] == 1.0 and g["mean"] == pytest.approx(w["mean"]) and g["followers"] == w["followers"]
    naive = df.filter("a1 = 1 and a2 = 1").agg(F.avg("y")).first()[0]
    assert abs(naive - 4.5) > 0.3
    part = longitudinal.plan_mean(df.filter("not (l1 = 1 and a1 = 0)"), (0, 0)).first()
    assert 0 < part["covered"] < 1
    assert longitudinal.plan_mean(df.filter("i < 0"), (1, 1)).collect()[0]["mean"] is None


def test_units_in_order(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 4.0), ("a", 3, 6.0), ("b", 1, 1.0)], "u string, t int, v double")
    assert [tuple(r) for r in longitudinal.units(df, "u", ["t"], {"v": "v"}, 2, "v").collect()] == [("a", 4.0, 5.0, 6.0)]


def test_controlled_effect_and_mediation(spark):
    rng = np.random.default_rng(2)
    n = 6000
    a = (rng.random(n) < 0.5).astype(float)
    u = rng.normal(size=n)
    between = a + u + rng.normal(size=n)
    m = 0.5 * a + between + rng.normal(size=n)
    y = 2 * a + 1.5 * m + 2 * u + rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, between, m, y, strict=True)], "a double, l double, m double, y double")
    r = longitudinal.sequential_g(spark, df, "a", "m", "y", ["l"]).first()
    assert r["direct"] == pytest.approx(2, abs=0.2) and r["mediator_effect"] == pytest.approx(1.5, abs=0.1)
    assert abs(np.linalg.lstsq(np.column_stack([np.ones(n), a, m, between]), y, rcond=None)[0][1] - 2) > 0.5  # the outcome model alone is biased
    steps = longitudinal.longitudinal_mediation(spark, df, "a", ["l", "m"], "y").collect()
    total = np.cov(a, y)[0, 1] / a.var(ddof=1)
    assert [s["step"] for s in steps] == [1, 2] and all(s["total"] == pytest.approx(total) for s in steps)


def test_sequential_backdoor():
    e = [("u", "l2"), ("u", "y"), ("a1", "l2"), ("l2", "a2"), ("a1", "y"), ("a2", "y")]
    assert longitudinal.sequential_backdoor(e, ["a1", "a2"], "y", [[], ["l2"]])
    assert not longitudinal.sequential_backdoor(e, ["a1", "a2"], "y", [["l2"], []])  # a descendant of a1
    assert not longitudinal.sequential_backdoor(e, ["a1", "a2"], "y", [[], []])


@pytest.mark.parametrize("kind", sorted(spectral.TAPERS))
def test_welch(spark, kind):
    rng = np.random.default_rng(3)
    n, length = 400, 32
    v = np.cos(2 * np.pi * 4 * np.arange(n) / length) + 0.1 * rng.normal(size=n)
    gone = {50, 51, 200}
    df = spark.createDataFrame([("s", t + 1000, float(x)) for t, x in enumerate(v) if t not in gone] + [("s", 1050, None), ("short", 1, 1.0)], "series string, t long, v double")
    got = {r["k"]: r["power"] for r in spectral.welch(df, length, kinds=[kind]).collect()}
    a, b, c = spectral.TAPERS[kind]
    x = 2 * np.pi * np.arange(length) / (length - 1)
    w = a + b * np.cos(x) + c * np.cos(2 * x)
    powers = []
    for at in range(0, n - length + 1, length // 2):
        i = np.arange(at, at + length)
        ok = np.array([j not in gone for j in i])
        d = np.where(ok, v[i] - v[i][ok].mean(), 0.0)
        powers.append(np.abs(np.fft.rfft(w * d)) ** 2)
    want = np.mean(powers, axis=0) / (w**2).sum() * np.where(np.isin(np.arange(length // 2 + 1), [0, length // 2]), 1, 2)
    assert np.allclose([got[k] for k in range(length // 2 + 1)], want) and max(got, key=got.get) == 4


def test_densities(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=800)
    y = 0.8 * x + 0.6 * rng.normal(size=800)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("c", 1.0, 1.0)] * 3, "series string, x double, y double")
    h = 1.06 * x.std(ddof=1) * 800**-0.2
    exact = -np.log(np.exp(-0.5 * ((x[:, None] - x) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))).mean()
    got = spectral.kernel_entropy(df, "x").collect()
    assert [r["series"] for r in got] == ["s"]  # a constant series has no density
    assert got[0]["h"] == pytest.approx(exact, abs=2e-3) and got[0]["h"] == pytest.approx(0.5 * np.log(2 * np.pi * np.e), abs=0.1)
    mi = spectral.kernel_information(df.filter("series = 's'"), "x", "y", 48).first()["mi"]
    hx, hy = (1.06 * v.std(ddof=1) * 800 ** (-1 / 6) for v in (x, y))
    kx, ky = (np.exp(-0.5 * ((v[:, None] - v) / w) ** 2) / (w * np.sqrt(2 * np.pi)) for v, w in ((x, hx), (y, hy)))
    assert mi == pytest.approx(np.log((kx * ky).mean(1) / kx.mean(1) / ky.mean(1)).mean(), abs=0.01)


def test_rows_of_few_groups_are_not_dealt_by_group(spark, monkeypatch):
    """Three groups used to send all rows to three tasks."""
    frames, write = {}, spectral.materialize
    monkeypatch.setattr(spectral, "materialize", lambda df, label: frames.setdefault(label, df) and write(df, label))
    df = spark.range(2_000_000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    assert spectral.kernel_information(df, "x", "y", 12, ["g"]).count() == 3
    plan = frames["cells"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
