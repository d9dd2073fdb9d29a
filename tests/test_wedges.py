"""Pairs of links are thrown away before they are shuffled."""

from infocausal.operators import census


def test_triangles_look_up_few_pairs(spark):
    """A sparse graph has many open pairs of links; what is looked up carries the filter's test below the join."""
    edges = [(i, (i * k + k) % 400) for i in range(400) for k in (3, 7, 11, 19)]
    pairs = census.dyads(spark.createDataFrame([e for e in edges if e[0] != e[1]], "src int, dst int"))
    t = census.triangles(pairs)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "m#" in plan and "&" in plan  # the join of two links of a node tests the filter
    link = {(a, b) for a, b in ((min(e), max(e)) for e in edges) if a != b}
    near = {v: {b for a, b in link if a == v} | {a for a, b in link if b == v} for v in range(400)}
    want = sum(len(near[a] & near[b]) for a, b in link) // 3
    assert t.count() == want


def test_rewiring_keeps_one_table(spark):
    """The tables of earlier rounds filled the disk."""
    from infocausal.scratch import tables

    before = len(tables)
    df = spark.createDataFrame([(i, (i * k + 1) % 60) for i in range(60) for k in (2, 5)], "src int, dst int")
    g = census.rewired(df, 2, 3)
    assert len(tables) == before + 1 and g.count() == 2 * df.filter("src != dst").distinct().count()
