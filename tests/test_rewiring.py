"""Rounds of swaps and lists of neighbours: against plain Python, and what they shuffle."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5
from itertools import combinations

from infocausal.operators import census


def plain(edges, rep, rounds, seed=1):
    boxes, g, clashes = max(len(edges) // 3, 1), set(edges), 0
    for i in range(rounds):
        unit = lambda e, tag: int(md5(f"{seed}|{i}|{rep}|{e[0]}|{e[1]}|{tag}".encode()).hexdigest()[:8], 16) / 2**32  # noqa: B023, E731
        met = defaultdict(list)
        for e in g:
            met[math.floor(unit(e, "box") * boxes)].append((unit(e, "order"), e))
        swaps = []
        for of in met.values():
            if len(of) > 1:
                (_, (a, b)), (_, (c, d)) = sorted(of)[:2]
                if a != d and c != b and a != c and b != d:
                    swaps.append(((a, b), (c, d), (a, d), (c, b)))
        made = Counter(e for s in swaps for e in s[2:])
        good = [s for s in swaps if not any(e in g or made[e] > 1 for e in s[2:])]
        clashes += len(swaps) - len(good)
        g = g - {e for s in good for e in s[:2]} | {e for s in good for e in s[2:]}
    return g, clashes


def test_rounds_equal_plain_ones_where_swaps_clash(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(25) for b in range(25) if a != b and rng.random() < 0.4}
    got = census.rewired(spark.createDataFrame(list(edges), "src int, dst int"), 2, 4).collect()
    want = [plain(edges, rep, 4) for rep in range(2)]
    assert all(clashes > 10 for _, clashes in want)
    assert [{(r["src"], r["dst"]) for r in got if r["rep"] == rep} for rep in range(2)] == [g for g, _ in want]


def test_a_round_deals_edges_twice(spark, monkeypatch):
    """Each round used to group, join and filter all edges some ten times, by sorted aggregates of structs."""
    plans, write = [], census.materialize
    monkeypatch.setattr(census, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    df = spark.createDataFrame([(i, (i * k + 1) % 60) for i in range(60) for k in (2, 5)], "src int, dst int")
    census.rewired(df, 2, 3)
    assert sum(p.count("REPARTITION_BY_NUM") for p in plans) == 2 * 3 and not any("SortAggregate" in p for p in plans)


def test_triangles_of_hubs_and_of_dyads_in_two_rows(spark):
    rng = random.Random(4)
    edges = {(a, b) for a in range(40) for b in range(40) if a != b and rng.random() < 0.05} | {(0, i) for i in range(1, 40)} | {(i, 1) for i in range(2, 30)}
    rows = [(min(e), max(e), 1 if e[0] < e[1] else 2) for e in edges]
    got = census.triangles(spark.createDataFrame(rows, "a int, b int, d int")).collect()
    code = lambda a, b: ((a, b) in edges) + 2 * ((b, a) in edges)
    want = {t for t in combinations(range(40), 3) if all(code(a, b) for a, b in combinations(t, 2))}
    assert len(got) == len(want) and {tuple(sorted((r["a"], r["b"], r["c"]))) for r in got} == want
    assert all((r["ab"], r["bc"], r["ac"]) == (code(r["a"], r["b"]), code(r["b"], r["c"]), code(r["a"], r["c"])) for r in got)
