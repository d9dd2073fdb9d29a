"""Class search against every graph, the score's invariance, and extensions."""

from itertools import combinations

import numpy as np
import pytest

from infocausal.operators import equivalence as eq
from infocausal.operators.dependence import Gram
from infocausal.plans.discovery_queries import all_graphs


def gram_of(names, parents, weight, n=200_000):
    """Moments of a linear model, as the population has them."""
    p = len(names)
    b = np.zeros((p, p))
    for i, v in enumerate(names):
        for w in parents[v]:
            b[i, names.index(w)] = weight[v, w]
    inv = np.linalg.inv(np.eye(p) - b)
    cov = inv @ inv.T
    return Gram.of_moments(names, {"n": n, **{f"m{i}": 0.0 for i in range(p)}, **{f"c{i}_{j}": cov[i, j] for i in range(p) for j in range(i, p)}})


def random_model(names, rng, density=0.5):
    order = list(rng.permutation(names))
    parents = {v: frozenset(str(w) for w in order[: order.index(v)] if rng.random() < density) for v in names}
    return parents, {(v, w): rng.choice([-1, 1]) * rng.uniform(0.4, 1.2) for v in names for w in parents[v]}


@pytest.fixture(scope="module")
def graphs():
    return {k: [{v: frozenset(p) for v, p in g.items()} for g in all_graphs(list("abcde"[:k]))] for k in (3, 4, 5)}


def test_number_of_graphs(graphs):
    assert [len(graphs[k]) for k in (3, 4, 5)] == [25, 543, 29281]


@pytest.mark.parametrize(("k", "seeds"), [(3, 12), (4, 25), (5, 3)])
@pytest.mark.parametrize("kind", ["bic", "bge"])
def test_equals_every_graph(graphs, k, seeds, kind):
    names = list("abcde"[:k])
    for seed in range(seeds):
        parents, weight = random_model(names, np.random.default_rng(seed))
        score = eq.scores(gram_of(names, parents, weight), kind)
        best = max(graphs[k], key=lambda g: eq.total(g, score))
        found, _ = eq.search(names, score)
        assert eq.total(eq.extension(names, found.arrows), score) == pytest.approx(eq.total(best, score), abs=1e-4)
        assert found.arrows == eq.class_of(parents).arrows == eq.class_of(best).arrows


@pytest.mark.parametrize("kind", ["bic", "bge"])
def test_members_of_a_class_score_alike(graphs, kind):
    rng = np.random.default_rng(7)
    cov = np.cov(rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)), rowvar=False, bias=True)
    gram = Gram.of_moments(list("abcd"), {"n": 300, **{f"m{i}": 0.0 for i in range(4)}, **{f"c{i}_{j}": cov[i, j] for i in range(4) for j in range(i, 4)}})
    score, by = eq.scores(gram, kind), {}
    for g in graphs[4]:
        by.setdefault(frozenset(eq.class_of(g).arrows), []).append(eq.total(g, score))
    assert len(by) == 185 and all(max(x) - min(x) < 1e-6 for x in by.values())


def test_extension_is_a_member_of_the_class(graphs):
    for g in graphs[4]:
        c = eq.class_of(g)
        made = eq.extension(c.names, c.arrows)
        assert eq.class_of(made).arrows == c.arrows
    square = {(a, b) for x, y in ("ab", "bc", "cd", "da") for a, b in ((x, y), (y, x))}
    assert eq.extension(list("abcd"), square) is None


def test_bge_equals_the_marginal_likelihood():
    """One variable: the density of a Student law of the rows, by its closed form through sums."""
    from math import lgamma, log, pi

    n, var = 40, 1.7
    gram = Gram.of_moments(["a"], {"n": n, "m0": 0.0, "c0_0": var})
    t, dof = 0.5, 3.0
    want = -n / 2 * log(pi) + 0.5 * log(1 / (n + 1)) + lgamma((n + dof) / 2) - lgamma(dof / 2) + dof / 2 * log(t) - (n + dof) / 2 * log(t + n * var)
    assert eq.bge_local(gram)("a", []) == pytest.approx(want)


def test_cliques_and_paths():
    c = eq.Class(list("abcd"), {("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")})
    assert c.reaches("a", "d", []) and not c.reaches("a", "d", ["c"]) and not c.reaches("d", "a", [])
    assert c.parents("b") == {"a"} and c.links("b") == {"c"} and c.clique(["b", "c"]) and not c.clique(["a", "c"])
    assert all(c.adjacent(a, b) for a, b in combinations("bc", 2))


def test_from_rows(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 4000))
    z = x + y + 0.5 * rng.normal(size=4000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, strict=True)], "x double, y double, z double")
    assert [tuple(r) for r in eq.ges(spark, df, ["x", "y", "z"]).collect()] == [("x", "z", True), ("y", "z", True)]
    s = {r["graph"]: r for r in eq.graph_scores(spark, df, ["x", "y", "z"], {"chain": {"y": ["x"], "z": ["y"]}, "back": {"y": ["z"], "x": ["y"]}, "right": {"z": ["x", "y"]}}).collect()}
    assert s["chain"]["bge"] == pytest.approx(s["back"]["bge"]) and s["right"]["bge"] > s["chain"]["bge"] and s["right"]["bic"] > s["chain"]["bic"]
