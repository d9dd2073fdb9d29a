import random
from collections import Counter
from itertools import combinations

import pytest

from infocausal.operators import communities


def blocks(rng, groups=4, size=12, inside=0.6, between=0.03):
    nodes = range(groups * size)
    return [(a, b) for a, b in combinations(nodes, 2) if rng.random() < (inside if a // size == b // size else between)]


def test_louvain_finds_blocks(spark):
    edges = blocks(random.Random(3))
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.community for r in communities.louvain(e).collect()}
    assert set(got) == {v for x in edges for v in x}
    truth = {v: v // 12 for v in got}

    def q(part):
        m, deg = len(edges), Counter(v for x in edges for v in x)
        k = Counter()
        for v, d in deg.items():
            k[part[v]] += d
        return sum(part[a] == part[b] for a, b in edges) / m - sum(x * x for x in k.values()) / (2 * m) ** 2

    assert q(got) >= q(truth) - 0.02 and len(set(got.values())) < 10
    assert communities.louvain(e.limit(0)).count() == 0


def plain_edge_betweenness(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    score = dict.fromkeys(edges, 0.0)
    for s in out:
        for t in out:
            paths, level = [], [(s,)]
            while level and not paths and s != t:
                level = [(*p, w) for p in level for w in out[p[-1]] if w not in p]
                paths = [p for p in level if p[-1] == t]
            for p in paths:
                for e in zip(p, p[1:], strict=False):
                    score[e] += 1 / len(paths)
    return score


def test_edge_betweenness_and_cuts():
    rng = random.Random(5)
    for _ in range(5):
        edges = sorted({(a, b) for a, b in ((rng.randrange(7), rng.randrange(7)) for _ in range(14)) if a != b})
        assert communities.edge_betweenness(edges) == pytest.approx(plain_edge_betweenness(edges))
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3)]
    assert sorted(map(sorted, communities.girvan_newman(two, 2))) == [[0, 1, 2], [3, 4, 5]]
