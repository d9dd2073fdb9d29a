"""Centroid clustering against plain rounds over all distances."""

import hashlib
import random

import numpy as np
import pytest

from infocausal.llm import op11_ball_clusters as op11
from infocausal.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import check


def brute(rows, p):
    """(id, cluster, distance) sorted, inertia by cluster, centroids; rows: (id, list)."""
    kept = [(i, [int(np.floor(p.scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == p.dims and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{p.salt}:{r[0]}".encode()).hexdigest(), r[1]))[: p.k]
    c = [v for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(p.rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, own, strict=True) if j == k] for k in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c[k] for k, g in enumerate(groups)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, j, d in last if j == k) for k in range(len(c))}
    return sorted(last, key=str), inertia, c


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, 5, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, n string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    p = op11.Clustering(k=5, rounds=3, dims=4, scale=8.0)
    hot = [0.5, -0.25, 1.0, 0.125]
    rows = [(i, [rng.gauss(rng.choice([-1, 1]), 0.5) for _ in range(4)]) for i in range(300)] + [(1000 + i, hot) for i in range(150)]
    rows += [rows[3], rows[3], (None, hot), (2000, None), (2001, [1.0] * 3), (2002, [1.0, None, 1.0, 1.0]), (2003, [1.0, float("nan"), 1.0, 1.0]), (2004, [float("inf")] * 4), (2005, [])]
    want, inertia, c = brute(rows, p)
    got = op11.cluster_vectors(rows_of(spark, rows), p).collect()
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=str) == want
    assert all(r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values()) and r["centroid"] == c[r["cluster"]] for r in got)


def test_few_none_and_huge(spark):
    p = op11.Clustering(k=4, rounds=2, dims=2, scale=2.0)
    assert op11.cluster_vectors(rows_of(spark, []), p).count() == 0
    assert op11.cluster_vectors(rows_of(spark, [(1, None), (2, [1.0])]), p).count() == 0
    same = op11.cluster_vectors(rows_of(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0])]), p).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in same) == [(1, 0, 0), (2, 0, 0)]
    huge = op11.cluster_vectors(rows_of(spark, [(1, [1e300, -1e300]), (2, [-1e300, 1e300])] + [(i, [0.0, 0.0]) for i in range(3, 40)]), p)
    assert huge.filter("distance < 0").count() == 0 and huge.count() == 39


def test_balls_hold_their_members_and_go_whole():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 3, (400, 6)) for c in (-100, 0, 100)]).astype(np.int64)
    tree = op11.BallTree(points)
    for i, j, r, pivot, s in zip(tree.first, tree.last, tree.radii, tree.pivots, tree.sums, strict=True):
        own = tree.points[i:j]
        assert (np.sqrt(((own - pivot) ** 2).sum(1)) <= r + 1e-9).all() and (own.sum(0) == s).all()
    asked = []
    exact, op11._exact = op11._exact, lambda p, c: (asked.append(len(p)), exact(p, c))[1]
    try:
        cluster, count, total = tree.assign(points[[0, 500, 1000]])
    finally:
        op11._exact = exact
    assert sum(asked) == 0 and count.tolist() == [400, 400, 400]  # whole balls, no leaf
    assert all((tree.points[cluster == k].sum(0) == total[k]).all() for k in range(3))


def test_query_equals_sql(spark):
    check(spark, QUERIES["op11_ball_clusters"], ORACLE_SQL["op11_ball_clusters"], "/root/testdata/sf0.001")
