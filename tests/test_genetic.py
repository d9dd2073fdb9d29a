"""Weighted Mahalanobis matching against all pairs, and the search for weights."""

import numpy as np
import pytest

from infocausal.operators import genetic


def data(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.multivariate_normal([0, 5, -2], [[1, 0.6, 0.2], [0.6, 2, 0.1], [0.2, 0.1, 0.5]], n)
    t = (rng.random(n) < 1 / (1 + np.exp(0.8 - 0.9 * x[:, 0]))).astype(int)
    y = 1.5 * t + 2 * x[:, 0] + rng.normal(size=n) * 0.3
    rows = [(i, int(t[i]), float(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t int, y double, a double, b double, c double"), x, t, y


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (2.0, 0.5, 1.0)])
def test_equals_all_pairs(spark, weights):
    df, x, t, _ = data(spark)
    got = {r["k"]: (r["match"], r["distance"]) for r in genetic.weighted_matches(df, ["a", "b", "c"], "k", [weights], 0.6).collect()}
    w = np.linalg.solve(np.linalg.cholesky(np.cov(x.T, bias=True)), (x - x.mean(0)).T).T * np.sqrt(weights)
    want = {}
    for i in np.flatnonzero(t == 1):
        d, j = min((round(float(np.linalg.norm(w[i] - w[j])), 12), int(j)) for j in np.flatnonzero(t == 0))
        if d <= 0.6:
            want[int(i)] = (j, d)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_equal_weights_are_mahalanobis(spark):
    df, x, *_ = data(spark, 100)
    w = np.array([[r["w0"], r["w1"], r["w2"]] for r in genetic.whitened(df, ["a", "b", "c"]).orderBy("k").collect()])
    inverse = np.linalg.inv(np.cov(x.T, bias=True))
    d = x[3] - x[7]
    assert np.linalg.norm(w[3] - w[7]) == pytest.approx(np.sqrt(d @ inverse @ d))
    twice = genetic.whitened(df.selectExpr("*", "2 * a + 1 as e", "7.0D as f"), ["a", "e", "f"]).first()
    assert twice["w1"] == 0 and twice["w2"] == 0


def test_search_is_never_worse_than_equal_weights(spark):
    df, *_ = data(spark, 600)
    r = genetic.genetic_match(spark, df, ["a", "b", "c"], "k", 1.0, population=5, generations=3).orderBy("generation").collect()
    equal = genetic.match_scores(df, ["a", "b", "c"], "k", [(1.0, 1.0, 1.0)], 1.0).first()
    cost = [x["imbalance"] + 1 - x["share"] for x in r]
    assert cost == sorted(cost, reverse=True) and cost[-1] <= equal["imbalance"] + 1 - equal["share"]
    assert r[-1]["att"] == pytest.approx(1.5, abs=0.5)


def test_no_treated(spark):
    df, *_ = data(spark, 50)
    assert genetic.match_scores(df.filter("t = 0"), ["a", "b"], "k", [(1.0, 1.0)], 0.5).count() == 0
