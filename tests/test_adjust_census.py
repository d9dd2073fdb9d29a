"""Adjustment sets on known graphs, and triads and rewiring against plain counting."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from infocausal.operators import adjust, census
from infocausal.operators.equivalence import class_of
from infocausal.operators.graph import backdoor_sets
from tests.test_equivalence import gram_of, random_model

CHAIN = [("a", "x"), ("a", "y"), ("x", "m"), ("m", "y"), ("b", "m"), ("c", "y"), ("x", "d"), ("y", "f")]


def test_optimal_set():
    assert adjust.causal_nodes(CHAIN, "x", "y") == {"m", "y"} and adjust.forbidden(CHAIN, "x", "y") == {"x", "m", "y", "f"}
    assert adjust.optimal_set(CHAIN, "x", "y") == {"a", "b", "c"} and adjust.parent_set(CHAIN, "x") == {"a"}
    assert adjust.optimal_set(CHAIN, "y", "x") is None
    assert adjust.valid_set(CHAIN, "x", "y", ["a", "d"]) and not adjust.valid_set(CHAIN, "x", "y", ["a", "m"]) and not adjust.valid_set(CHAIN, "x", "y", [])
    assert adjust.valid_sets(CHAIN, "x", "y", minimal=True) == [("a",)]


def test_back_door_sets_are_valid():
    for seed in range(10):
        parents, _ = random_model(list("abcde"), np.random.default_rng(seed))
        edges = [(p, v) for v, ps in parents.items() for p in ps]
        for x, y in combinations("abcde", 2):
            got = set(adjust.valid_sets(edges, x, y, "abcde")) if y in adjust.causal_nodes(edges, x, y) else None
            if got is not None:
                assert {z for z in backdoor_sets(edges, x, y)} <= got


def test_least_variance_among_all_valid_sets():
    done = 0
    for seed in range(40):
        names = list("abcdef")
        parents, weight = random_model(names, np.random.default_rng(seed))
        edges = [(p, v) for v, ps in parents.items() for p in ps]
        for x, y in ((a, b) for a in names for b in names if a != b):
            best = adjust.optimal_set(edges, x, y)
            if best is None:
                continue
            gram = gram_of(names, parents, weight)
            errors = {z: adjust.adjusted(gram, x, y, z) for z in adjust.valid_sets(edges, x, y, names)}
            assert tuple(sorted(best)) in errors
            total = sum(np.prod([weight[b, a] for a, b in zip(p, p[1:], strict=False)]) for p in paths(edges, x, y))
            assert all(e[0] == pytest.approx(total, abs=1e-6) for e in errors.values())
            assert errors[tuple(sorted(best))][1] <= min(e[1] for e in errors.values()) * (1 + 1e-9)
            done += 1
    assert done > 100


def paths(edges, x, y):
    return [[x, y]] * ((x, y) in edges) + [[x, *p] for a, b in edges if a == x and b != y for p in paths(edges, b, y)]


def test_sets_for_a_class():
    collider = class_of({"a": frozenset(), "b": frozenset(), "x": frozenset("ab"), "y": frozenset("x")}).arrows
    assert adjust.amenable(collider, "x", "y") and adjust.valid_in_class(collider, "x", "y", []) and not adjust.valid_in_class(collider, "x", "y", ["y"])
    link = class_of({"x": frozenset(), "y": frozenset("x")}).arrows
    assert not adjust.amenable(link, "x", "y") and not adjust.valid_in_class(link, "x", "y", [])
    for seed in range(15):
        parents, _ = random_model(list("abcd"), np.random.default_rng(seed))
        g = class_of(parents)
        members = [m for m in members_of(g)]
        for x, y in (("a", "b"), ("c", "d"), ("d", "a")):
            for k in range(3):
                for z in combinations(sorted(set("abcd") - {x, y}), k):
                    # A set is valid for the class just where it is valid in all members and the class tells the ways apart.
                    each = all(adjust.valid_set([(p, v) for v, ps in m.items() for p in ps], x, y, z) for m in members)
                    if adjust.amenable(g.arrows, x, y):
                        assert adjust.valid_in_class(g.arrows, x, y, z) == each


def members_of(g):
    links = sorted((a, b) for a, b in g.arrows if a < b and g.linked(a, b))
    for turn in range(1 << len(links)):
        arrows = {(a, b) for a, b in g.arrows if not g.linked(a, b)} | {(a, b) if turn >> i & 1 else (b, a) for i, (a, b) in enumerate(links)}
        parents = {v: frozenset(a for a, b in arrows if b == v) for v in g.names}
        left = set(g.names)
        while left and (free := {v for v in left if not parents[v] & left}):
            left -= free
        if not left and class_of(parents).arrows == g.arrows:
            yield parents


def test_causes_and_colliders():
    m = [("u", "x"), ("u", "m"), ("v", "m"), ("v", "y"), ("x", "y")]
    assert adjust.harmful(m, "x", "y") == ["m"] and adjust.harmful([*m, ("c", "x"), ("c", "y")], "x", "y") == []
    assert adjust.disjunctive_causes(CHAIN, "x", "y") == {"a", "b", "c"} and adjust.disjunctive_causes(CHAIN, "x", "y", "ab") == {"a", "b"}


def test_effects_from_rows(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=3000)
    x = q + rng.normal(size=3000)
    y = 2 * x + q + rng.normal(size=3000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(q, x, y, strict=True)], "q double, x double, y double")
    r = adjust.most_efficient(adjust.adjusted_effects(spark, df, [("q", "x"), ("q", "y"), ("x", "y")], "x", "y")).first()
    assert r["adjusted"] == "q" and r["optimal"] and r["estimate"] == pytest.approx(2, abs=0.1) and r["se"] == pytest.approx(1 / np.sqrt(3000), rel=0.1)


KINDS = {
    "003": "", "012": "ab", "102": "ab ba", "021D": "ba bc", "021U": "ab cb", "021C": "ab bc", "111D": "ab ba cb", "111U": "ab ba bc", "030T": "ab bc ac", "030C": "ab bc ca", "201": "ab ba bc cb",
    "120D": "ba bc ac ca", "120U": "ab cb ac ca", "120C": "ab bc ac ca", "210": "ab bc cb ac ca", "300": "ab ba bc cb ac ca",
}


def brute_census(edges, nodes):
    canon = lambda e, vs: min(tuple(sorted((p[a], p[b]) for a, b in e)) for p in ({v: i for v, i in zip(vs, o, strict=True)} for o in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))))
    known = {canon([tuple(x) for x in s.split()], "abc"): k for k, s in KINDS.items()}
    out = Counter()
    for vs in combinations(sorted(nodes), 3):
        out[known[canon([e for e in edges if set(e) <= set(vs)], vs)]] += 1
    return {k: out[k] for k in KINDS}


@pytest.mark.parametrize("density", [0.03, 0.15, 0.5])
def test_census_equals_all_triples(spark, density):
    rng = random.Random(int(density * 100))
    edges = {(a, b) for a in range(18) for b in range(18) if a != b and rng.random() < density} | {(0, i) for i in range(1, 18)}
    df = spark.createDataFrame([*edges, (3, 3), next(iter(edges))], "src int, dst int")
    assert {r["kind"]: r["n"] for r in census.triad_census(df).collect()} == brute_census(edges, range(18))


def test_census_of_given_nodes(spark):
    df = spark.createDataFrame([(1, 2)], "src int, dst int")
    got = {r["kind"]: r["n"] for r in census.triad_census(df, spark.createDataFrame([(i,) for i in range(1, 6)], "node int")).collect()}
    assert got["012"] == 3 and got["003"] == 7 and sum(got.values()) == 10
    assert sum(r["n"] for r in census.triad_census(df.limit(0)).collect()) == 0


def test_rewiring_keeps_degrees(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(260)}
    edges = {(a, b) for a, b in edges if a != b}
    got = census.rewired(spark.createDataFrame(list(edges), "src int, dst int"), 3, 5).collect()
    for rep in range(3):
        made = [(r["src"], r["dst"]) for r in got if r["rep"] == rep]
        assert len(made) == len(set(made)) == len(edges) and all(a != b for a, b in made)
        assert all(Counter(e[i] for e in made) == Counter(e[i] for e in edges) for i in (0, 1))
        assert len(set(made) - edges) > len(edges) / 4


def test_motif_scores_see_planted_triangles(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(100)} | {e for i in range(0, 60, 3) for e in ((i, i + 1), (i + 1, i + 2), (i, i + 2))}
    r = {x["kind"]: x for x in census.motif_scores(spark.createDataFrame([e for e in edges if e[0] != e[1]], "src int, dst int"), 6, 6).collect()}
    assert r["030T"]["n"] >= 20 and r["030T"]["z"] > 2
