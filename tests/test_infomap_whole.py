"""Rounds of moves go on until no node's own move shortens the code."""

import pytest

from infocausal.operators import mapequation as me
from infocausal.plans import community_queries
from tests.test_mapequation import plain_length


def left(flow, module):
    """The most nats that a node's move to the module of a linked one saves."""
    now, near = plain_length(flow, module), {}
    for a, b, _ in flow:
        near.setdefault(a, set()).add(module[b])
    return max(now - plain_length(flow, module | {v: m}) for v, ms in near.items() for m in ms | {module[v]})


def test_query_leaves_no_move(spark):
    """Four rounds in each of three levels left many modules where one is the shortest code."""
    e = community_queries.supply(spark, "/root/testdata/sf0.001").cache()
    flow = [tuple(r) for r in me.link_flow(e).collect()]
    module = {r["node"]: r["module"] for r in community_queries.infomap_supply(spark, "/root/testdata/sf0.001").collect()}
    assert set(module) == {v for a, b, _ in flow for v in (a, b)} and left(flow, module) < 1e-9
    assert plain_length(flow, module) <= plain_length(flow, dict.fromkeys(module, 0)) + 1e-9


@pytest.mark.parametrize("size", [60])
def test_ring_leaves_no_move(spark, size):
    """A ring takes moves that clash: neighbours in one share change places."""
    e = spark.createDataFrame([(i, (i + 1) % size) for i in range(size)], "src int, dst int")
    flow = [tuple(r) for r in me.link_flow(e).collect()]
    labels = me.infomap(e, levels=1)
    assert left(flow, {r["node"]: r["module"] for r in labels.collect()}) < 1e-9
