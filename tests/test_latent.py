import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from infocausal.operators import bounds, dependence, latent, resampling, statistics
from infocausal.sources import tables


def moments(names, weights, noise=None, hidden=()):
    """The matrix of a linear model, hidden variables left out; weights (cause, effect) -> coefficient."""
    n = len(names)
    b = np.zeros((n, n))
    for (a, c), w in weights.items():
        b[names.index(c), names.index(a)] = w
    m = np.linalg.inv(np.eye(n) - b)
    keep = [i for i, v in enumerate(names) if v not in hidden]
    g = dependence.Gram.__new__(dependence.Gram)
    g.columns, g.n = [names[i] for i in keep], 100_000
    g.cov, g.mean = (m @ m.T)[np.ix_(keep, keep)], np.zeros(len(keep))
    return g


def test_fci_of_a_y_structure():
    g = moments(list("xyzw"), {("x", "z"): 0.8, ("y", "z"): 0.7, ("z", "w"): 0.9})
    pag, _ = latent.fci_graph(g)
    assert pag.rows() == [("w", "z", "<--"), ("x", "z", "o->"), ("y", "z", "o->")] and latent.valid_pag(pag.rows())
    assert latent.fci_graph(g, fast=True)[0].rows() == pag.rows()


def test_fci_finds_a_hidden_cause():
    """a -> b <- h -> c <- d: b and c share a hidden cause, so their edge has two heads."""
    g = moments(list("abcdh"), {("a", "b"): 0.8, ("h", "b"): 0.9, ("h", "c"): 0.9, ("d", "c"): 0.8}, hidden="h")
    assert latent.fci_graph(g)[0].rows() == [("a", "b", "o->"), ("b", "c", "<->"), ("c", "d", "<-o")]


def test_discriminating_path_decides():
    """d -> a <-> b <-> c (or b -> c) with a -> c: rule 4 tells the two apart."""
    two = {("d", "a"): 0.9, ("h", "a"): 0.8, ("h", "b"): 0.8, ("a", "c"): 0.7}
    hidden = moments(list("abcdhk"), {**two, ("k", "b"): 0.8, ("k", "c"): 0.8}, hidden="hk")
    cause = moments(list("abcdh"), {**two, ("b", "c"): 0.8}, hidden="h")
    assert ("b", "c", "<->") in latent.fci_graph(hidden)[0].rows()
    assert ("b", "c", "-->") in latent.fci_graph(cause)[0].rows()


def test_possible_d_sep_pass_removes_an_edge():
    """The classic case: the separating set holds no neighbour of either end."""
    w = {("a", "b"): 0.8, ("h", "b"): 0.8, ("h", "d"): 0.8, ("k", "c"): 0.8, ("k", "e"): 0.8, ("e", "d"): 0.8, ("b", "a2"): 0.7, ("c", "a2"): 0.0}
    names = ["a", "b", "c", "d", "e", "a2", "h", "k"]
    g = moments(names, w, hidden=("h", "k"))
    slow, fast = latent.fci_graph(g)[0], latent.fci_graph(g, fast=True)[0]
    assert {r[:2] for r in slow.rows()} <= {r[:2] for r in fast.rows()} and latent.valid_pag(slow.rows())


def test_graph_comparisons():
    chain, back, fork, collider = [("a", "b"), ("b", "c")], [("c", "b"), ("b", "a")], [("b", "a"), ("b", "c")], [("a", "b"), ("c", "b")]
    assert latent.markov_equivalent(chain, back) and latent.markov_equivalent(chain, fork) and not latent.markov_equivalent(chain, collider)
    assert latent.colliders(collider) == {("a", "b", "c")}
    undirected = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert latent.hamming(set(chain), set(collider)) == 1 and latent.hamming(set(chain), undirected) == 2 and latent.hamming(set(chain), set(chain)) == 0
    assert latent.valid_class(undirected) and latent.valid_class(set(chain))
    square = {(x, y) for a, b in ("ab", "bc", "cd", "da") for x, y in ((a, b), (b, a))}
    assert not latent.valid_class(square) and not latent.valid_class({("a", "b"), ("b", "c"), ("c", "a")})
    assert not latent.valid_pag([("a", "b", "-->"), ("b", "c", "-->"), ("a", "c", "<--")])
    dag = [("z", "x"), ("z", "y"), ("x", "y"), ("y", "w"), ("v", "w")]
    assert latent.markov_blanket(dag, "y") == {"z", "x", "w", "v"} and latent.separators(dag, "z", "w") == [("y",)]
    assert latent.backdoor_paths(dag, "x", "y") == [("x", "z", "y")]
    assert latent.blocked(dag, ("x", "z", "y"), {"z"}) and not latent.blocked(dag, ("x", "z", "y"), set())
    assert latent.blocked(dag, ("y", "w", "v"), set()) and not latent.blocked(dag, ("y", "w", "v"), {"w"})


def test_scores_and_colliders():
    g = moments(list("xyzw"), {("x", "z"): 0.8, ("y", "z"): 0.7, ("z", "w"): 0.9})
    edges = {frozenset(p) for p in ("xz", "yz", "zw")}
    sure, doubt = latent.conservative_colliders(g, edges)
    assert sure == {("x", "z", "y")} and not doubt
    found, score = latent.tabu(g)
    assert latent.markov_equivalent(sorted(found), [("x", "z"), ("y", "z"), ("z", "w")])
    assert score == pytest.approx(sum(g.bic(v, p) for v, p in (("x", []), ("y", []), ("z", ["x", "y"]), ("w", ["z"]))))


def test_non_gaussian_order(spark):
    u = lambda s: tables.uniform(s, F.col("id")) - 0.5
    d = spark.range(20_000).select(u(1).alias("c"), u(2).alias("n2"), u(3).alias("n3")).withColumn("a", 0.9 * F.col("c") + F.col("n2")).withColumn("b", 0.8 * F.col("a") + F.col("n3"))
    assert latent.non_gaussian_order(d, ["a", "b", "c"]) == ["c", "a", "b"]


def plain_phrases(s):
    n, i = 0, 0
    while i < len(s):
        k = 1
        while i + k <= len(s) and any(s[p : p + k] == s[i : i + k] for p in range(i)):
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases():
    rng = random.Random(2)
    assert statistics.phrases([0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1]) == 6
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(40))]
        assert statistics.phrases(s) == plain_phrases(s)


def test_surrogates_keep_what_they_promise(spark):
    rows = [("s", t, math.sin(t / 3) + (t * 7919 % 13) / 13) for t in range(64)]
    df = spark.createDataFrame(rows, "series string, t long, v double")
    x = np.array([r[2] for r in rows])
    power = np.abs(np.fft.rfft(x))
    of = lambda d, r: np.array([q.v for q in d.filter(F.col("rep") == r).orderBy("i").collect()])
    ft, adjusted = resampling.spectral_surrogates(df, 2, False), resampling.spectral_surrogates(df, 2, True)
    assert np.allclose(np.abs(np.fft.rfft(of(ft, 1))), power) and not np.allclose(of(ft, 1), of(ft, 2))
    assert np.allclose(np.sort(of(adjusted, 1)), np.sort(x)) and np.corrcoef(np.abs(np.fft.rfft(of(adjusted, 1))), power)[0, 1] > 0.95
    for d in (resampling.shuffled(df, 2), resampling.shifted(df, 2)):
        assert np.allclose(np.sort(of(d, 2)), np.sort(x)) and len(of(d, 1)) == 64
    turned = of(resampling.shifted(df, 2), 1)
    assert any(np.allclose(np.roll(x, k), turned) for k in range(64))
    b = of(resampling.block_bootstrap(df, 2, 8), 1)
    where = [int(np.flatnonzero(np.isclose(x, v))[0]) for v in b]
    assert len(b) == 64 and all((where[i + 1] - where[i]) % 64 == 1 for i in range(63) if i % 8 != 7)
    s = of(resampling.stationary_bootstrap(df, 2, 8), 2)
    where = [int(np.flatnonzero(np.isclose(x, v))[0]) for v in s]
    assert len(s) == 64 and 40 < sum((q - p) % 64 == 1 for p, q in zip(where, where[1:], strict=False)) < 63


def test_intervals(spark):
    rng = np.random.default_rng(4)
    v = rng.exponential(size=400)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "series string, t long, v double")
    j = resampling.jackknife_mean(df, ["series"], "v").first()
    leave = (v.sum() - v) / 399
    u = leave.mean() - leave
    assert j["mean"] == pytest.approx(v.mean()) and j.se == pytest.approx(math.sqrt(399 / 400 * (u**2).sum())) and j.acceleration == pytest.approx((u**3).sum() / 6 / (u**2).sum() ** 1.5)
    reps = resampling.block_bootstrap(df, 300, 1).groupBy("series", "rep").agg(F.avg("v").alias("m"))
    p = resampling.percentile_interval(reps, ["series"], "m").first()
    assert p.low < v.mean() < p.high and p.se == pytest.approx(v.std() / 20, rel=0.2) and p.n == 300
    c = resampling.corrected_interval(reps, resampling.jackknife_mean(df, ["series"], "v"), ["series"], "m").first()
    m, a = np.sort([r.m for r in reps.collect()]), ((u**3).sum() / 6 / (u**2).sum() ** 1.5)
    normal = NormalDist()
    z0 = normal.inv_cdf((m < v.mean()).mean())
    want = [np.quantile(m, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    assert [c.low, c.high] == pytest.approx(want) and c.low < v.mean() < c.high
    t = resampling.permutation_p(reps.limit(1).select("series", F.lit(9.0).alias("m")), reps, ["series"], "m").first()
    assert t.p == pytest.approx(1 / 301) and t.corrected == pytest.approx(9 - t["mean"])


def test_planning():
    assert bounds.sample_size(0.5, 1.0) == 63 and bounds.detectable_effect(63, 1.0) == pytest.approx(0.5, abs=0.01)


def test_regularity_of_a_repeating_series(spark):
    df = spark.createDataFrame([("p", t, float(t % 2)) for t in range(40)] + [("r", t, float((t * t * 7919) % 101)) for t in range(40)], "series string, t long, v double")
    got = {r.series: r for r in statistics.regularity(df).collect()}
    assert got["p"].sample_entropy == pytest.approx(0, abs=0.03) and got["p"].approximate_entropy == pytest.approx(0, abs=0.03)
    assert got["r"].approximate_entropy > got["p"].approximate_entropy
