"""The map equation against its plain formula, and communities against planted blocks."""

import math
import random
from collections import defaultdict

import pytest

from infocausal.operators import mapequation as me


def blocks(k=4, size=8, seed=1, inside=0.8, between=0.03):
    rng = random.Random(seed)
    n = k * size
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else between)]


def plain_length(flow, module):
    p, e, x = defaultdict(float), defaultdict(float), defaultdict(float)
    for a, b, f in flow:
        p[b] += f
        if module[a] != module[b]:
            x[module[a]] += f
            e[module[b]] += f
    pl = lambda v: v * math.log(v) if v > 0 else 0.0
    inside = defaultdict(float)
    for v, q in p.items():
        inside[module[v]] += q
    index = sum(e.values())
    moving = -sum(pl(v / index) for v in e.values()) * index if index else 0.0
    within = 0.0
    for m in set(module.values()):
        total = x[m] + inside[m]
        if total > 0:
            within -= total * (pl(x[m] / total) + sum(pl(q / total) for v, q in p.items() if module[v] == m))
    return moving + within


@pytest.mark.parametrize("directed", [False, True])
def test_length_equals_two_codebooks(spark, directed):
    df = spark.createDataFrame([*blocks(), (3, 3)], "src int, dst int")
    flow = me.link_flow(df, directed)
    rows = [tuple(r) for r in flow.collect()]
    assert sum(f for *_, f in rows) == pytest.approx(1)
    nodes = {v for a, b, _ in rows for v in (a, b)}
    for of in (lambda v: v // 8, lambda v: 0, lambda v: v % 5):
        labels = spark.createDataFrame([(v, of(v)) for v in nodes], "node long, module long")
        assert me.code_length(flow, labels) == pytest.approx(plain_length(rows, {v: of(v) for v in nodes}))


@pytest.mark.parametrize("directed", [False, True])
def test_planted_blocks(spark, directed):
    e = blocks(3, 6, seed=3)
    if directed:
        rng = random.Random(9)
        e = [x for a, b in e for x in ((a, b), (b, a)) if rng.random() < 0.9]
    df = spark.createDataFrame(e, "src int, dst int")
    labels = me.infomap(df, directed, rounds=6)
    assert {r["node"]: r["module"] for r in labels.collect()} == {v: v // 6 * 6 for v in range(18)}


def test_no_edges(spark):
    assert me.infomap(spark.createDataFrame([(1, 1)], "src int, dst int")).count() == 0


def test_rounds_send_links_of_the_moving_half_only(spark, monkeypatch):
    """Each round used to shuffle all links both ways five times, some with ten numbers; labels now go to links that lie in buckets."""
    plans, write = [], me.materialize
    monkeypatch.setattr(me, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = me.infomap(spark.createDataFrame(blocks(3, 6, seed=3), "src int, dst int"), rounds=6)
        assert {r["node"]: r["module"] for r in labels.collect()} == {v: v // 6 * 6 for v in range(18)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves = [p for label, p in plans if label == "labels"][1:]
    dealt = lambda p: [x for x in p.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x]
    assert moves and all(len(dealt(p)) == 1 and "Bucketed: true" in p for p in moves)


def test_tasks_follow_links(spark, monkeypatch):
    """However few shuffle partitions are set, one task gets a bounded share of the links."""
    from infocausal import scratch

    monkeypatch.setattr(scratch, "TASK_ROWS", 20)
    flow = me.link_flow(spark.createDataFrame(blocks(), "src int, dst int"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert flow.rdd.getNumPartitions() == -(-flow.count() // 20) > 4
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
