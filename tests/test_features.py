"""Kernel tests on random features: level, power, direction, and odd input."""

import numpy as np
import pytest

from infocausal.operators import features
from infocausal.operators.features import Cosines, KernelTest


def plain(fs, z):
    w, b = np.array(fs.weights), np.array(fs.phases)
    return np.sqrt(2 / fs.d) * np.cos(z @ w.T + b)


def plain_test(x, y, z, p):
    """statistic and gamma p by numpy; z: n x k (k may be 0)."""
    x, y = ((v - v.mean()) / v.std() for v in (x, y))
    z = (z - z.mean(0)) / z.std(0) if z.shape[1] else z
    fx, fy, fz = p.sides(z.shape[1])
    f = np.column_stack([plain(fx, np.column_stack([x, z])), plain(fy, y[:, None]), *([plain(fz, z)] if fz else [])])
    cov = np.cov(f.T, bias=True)
    k = fx.d + fy.d
    left, _ = features.partialled(cov, list(range(k)), list(range(k, f.shape[1])), p.ridge)
    t = len(x) * (left[: fx.d, fx.d :] ** 2).sum()
    return t, features.gamma_p(t, left[: fx.d, : fx.d], left[fx.d :, fx.d :])


@pytest.mark.parametrize("given", [0, 1])
def test_level_under_independence(given):
    rng, ps = np.random.default_rng(1), []
    for _ in range(300):
        z = rng.normal(size=(400, given))
        x, y = rng.normal(size=400), rng.normal(size=400)
        if given:
            x, y = x + z[:, 0] ** 2, y + np.sin(2 * z[:, 0])
        ps.append(plain_test(x, y, z, KernelTest())[1])
    ps = np.sort(ps)
    assert np.abs(ps - np.arange(1, 301) / 300).max() < 1.63 / np.sqrt(300) + 0.03  # Kolmogorov's bound at 1 %, and the approximation's own error
    assert 0.005 < (ps < 0.05).mean() < 0.11


def frame(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    x = z + 0.5 * rng.normal(size=n)
    rows = {"i": np.arange(n), "z": z, "x": x, "y": z**2 + 0.5 * rng.normal(size=n), "w": x**2 + rng.normal(size=n) * 0.3, "c": np.ones(n)}
    return spark.createDataFrame([tuple(float(v[i]) if k != "i" else int(i) for k, v in rows.items()) for i in range(n)], list(rows)), rows


def test_dependence_that_the_condition_explains(spark):
    df, rows = frame(spark)
    p = KernelTest(replicates=60)
    seen = features.kernel_test(df, "x", "y", key=["i"], p=p).first()
    given = features.kernel_test(df, "x", "y", ["z"], ["i"], p).first()
    still = features.kernel_test(df, "x", "w", ["z"], ["i"], p).first()
    assert seen["p"] < 1e-6 and seen["p_signs"] == pytest.approx(1 / 61)
    assert given["p"] > 0.01 and given["p_signs"] > 0.01
    assert still["p"] < 1e-6 and still["p_signs"] == pytest.approx(1 / 61)
    t, q = plain_test(rows["x"], rows["y"], rows["z"][:, None], p)
    assert given["statistic"] == pytest.approx(t, rel=1e-6) and given["p"] == pytest.approx(q, rel=1e-6)


def test_odd_input(spark):
    df, _ = frame(spark, 50)
    odd = df.unionByName(spark.createDataFrame([(99, None, 1.0, None, 1.0, 1.0)], df.schema))
    r = features.kernel_test(odd, "x", "y", ["z"], ["i"]).first()
    assert r["n"] == 50
    constant = features.kernel_test(df, "x", "c", key=["i"]).first()
    assert constant["statistic"] < 1e-20 and constant["p"] == 1.0
    none = features.kernel_test(df.filter("i < 0"), "x", "y", ["z"], ["i"]).first()
    assert none["n"] == 0 and none["p"] == 1.0


def test_direction_of_added_noise(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1.5, 1.5, 3000)
    y = x**3 + x + rng.uniform(-0.4, 0.4, 3000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    for d in (df, df.select("y", "x")):
        rows = {r["cause"]: r for r in features.noise_direction(d, *d.columns).collect()}
        assert rows["x"]["statistic"] < rows["y"]["statistic"] / 3 and rows["x"]["r2"] > 0.9


def test_kernel_granger_sees_what_a_line_misses(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=800)
    y = np.concatenate([[0.0], x[:-1] ** 2]) + 0.3 * rng.normal(size=800)
    df = spark.createDataFrame([(s, t, float(v)) for s, a in (("x", x), ("y", y)) for t, v in enumerate(a)], "series string, t long, v double")
    p = {(r["source"], r["target"]): r["p"] for r in features.kernel_granger(df, Cosines.drawn(1, 6, 1), Cosines.drawn(2, 12, 2)).collect()}
    assert p["x", "y"] < 1e-6 < 0.01 < p["y", "x"]


def test_moments(spark):
    df, rows = frame(spark, 300)
    m = features.Moments(df.repartition(5), [df["x"], df["y"]])
    assert m.n == 300 and np.allclose(m.cov, np.cov(rows["x"], rows["y"], bias=True)) and np.allclose(m.mean, [rows["x"].mean(), rows["y"].mean()])


def test_tests_share_their_scans(spark, monkeypatch):
    """Each test used to scan the rows three times and to hash their keys anew."""
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame([(i, x, x * x + 0.5 * y, z) for i, x, y, z in rows], "i long, x double, y double, z double")
    tests = [("x", "y", []), ("x", "z", []), ("x", "y", ["z"])]
    p = features.KernelTest(d=4, d_given=4, replicates=60)
    for data in (df, df.unionByName(spark.createDataFrame([(900, None, 1.0, 2.0), (901, 0.5, 1.0, None)], df.schema))):
        alone = [features.kernel_test(data, *t, ["i"], p).first() for t in tests]
        scans, init = [], features.Moments.__init__
        monkeypatch.setattr(features.Moments, "__init__", lambda self, *a, **k: scans.append(1) or init(self, *a, **k))
        together = features.kernel_tests(data, tests, ["i"], p).collect()
        monkeypatch.undo()
        for a, b in zip(alone, together, strict=True):
            assert a["n"] == b["n"] and a["p_signs"] == b["p_signs"] and a["given"] == b["given"]
            assert abs(a["statistic"] - b["statistic"]) < 1e-9 and abs(a["p"] - b["p"]) < 1e-9
        assert len(scans) == (1 if data is df else 3)
