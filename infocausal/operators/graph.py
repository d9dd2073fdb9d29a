"""Directed graphs as edge tables (src, dst): motifs, centrality and causal-graph surgery as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.scratch import materialize, n_tasks, tasks_for


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree for every node with an edge."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """n_edges, reciprocity (the share of edges that are answered; without edges not a number)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("r"))
    j = edges.filter("src != dst").join(back, ["src", "dst"], "left")
    share = F.coalesce(F.count("r") / F.nullif(F.count("*"), F.lit(0)), F.lit(float("nan")))
    return j.agg(F.count("*").alias("n_edges"), share.alias("reciprocity"))


def feed_forward_loops(edges: DataFrame) -> DataFrame:
    """The number of x -> y, y -> z, x -> z over three different nodes."""
    e = edges.filter("src != dst")
    xy = e.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    yz = e.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    xz = e.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    return xy.join(yz, "y").filter("x != z").join(xz, ["x", "z"], "left_semi").agg(F.count("*").alias("n_ffl"))


def bifans(edges: DataFrame) -> DataFrame:
    """Pairs of sources times pairs of targets: for k shared targets of two sources, k (k - 1) / 2."""
    a = edges.select(F.col("src").alias("x"), "dst")
    b = edges.select(F.col("src").alias("y"), "dst")
    shared = a.join(b, "dst").filter("x < y and dst != x and dst != y").groupBy("x", "y").agg(F.count("*").alias("k"))
    return shared.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("n_bifan"))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c: the triangles of the undirected graph, each once.

    Links point from the end with fewer links to that with more, and wedges are made at their start,
    so a hub starts few of them: wedges follow edges to the power of one and a half at most.
    """
    u = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = u.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    ends = u.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") <= F.struct("db", "b")
    e = materialize(ends.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "links")
    wedge = e.select("x", F.col("y").alias("p")).join(e.select("x", F.col("y").alias("q")), "x").filter("p < q")
    near = e.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
    return wedge.join(near, ["p", "q"], "left_semi").select(F.col("x").alias("a"), F.col("p").alias("b"), F.col("q").alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, clustering of the undirected graph; only nodes with two neighbours or more."""
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    u = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = u.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("degree"))
    closed = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    out = deg.filter("degree > 1").join(closed, "n", "left")
    return out.select(F.col("n").alias("node"), "degree", (2 * F.coalesce("c", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def degree_entropy(edges: DataFrame) -> DataFrame:
    d = edges.groupBy("src").agg(F.count("*").alias("k"))
    total = F.sum("k")
    return d.agg((F.log(total) - F.sum(F.col("k") * F.log("k")) / total).alias("h"))


#: Edges for which an iterated step gets a task.
EDGES_PER_TASK = 100_000


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank after fixed rounds; rank of nodes without out-edges is not passed on.

    The shares are written once, dealt out by their source; every fifth round is written out.
    """
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    tasks = max(1, min(n_tasks(edges.sparkSession), e.count() // EDGES_PER_TASK))
    nodes = materialize(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().coalesce(tasks), "nodes")
    n = nodes.count()
    shares = materialize(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src").select("src", "dst", (1 / F.col("k")).alias("w")).coalesce(tasks), "shares")
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for i in range(rounds):
        given = shares.join(rank.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("rank") * F.col("w")).alias("g"))
        base = nodes.select("node", F.lit(0.0).alias("g"))
        got = given.unionByName(base).coalesce(tasks).groupBy("node").agg(F.sum("g").alias("g"))
        rank = got.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("g")).alias("rank"))
        if i % 5 == 4:
            rank = materialize(rank, "rank")
    return rank


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, hops: all that the nodes of `start` (node) reach, by frontier joins with an anti-join on what is known."""
    known = front = materialize(start.select("node", F.lit(0).alias("hops")).distinct(), "reach")
    hop = 0
    while True:
        hop += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = materialize(step.join(known, "node", "left_anti"), "front")
        if front.isEmpty():
            return known
        known = materialize(known.unionByName(front), "reach")


def _parents(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The edges, written; a < b, c: all pairs of parents; and the tasks that keep each at a bounded share of pairs and edges."""
    spark = edges.sparkSession
    e = materialize(edges.select("src", "dst"), "edges")
    n_edges = e.count()
    pairs = e.select("dst").repartition(tasks_for(spark, n_edges), "dst").groupBy("dst").agg(F.count("*").alias("k")).agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0] or 0
    side = lambda name: e.select(F.col("src").alias(name), F.col("dst").alias("c")).repartition(tasks_for(spark, n_edges), "c")
    return e, side("a").join(side("b"), "c").filter("a < b").select("a", "b", "c"), tasks_for(spark, pairs + n_edges)


def v_structures(edges: DataFrame) -> DataFrame:
    """a, c, b: a -> c <- b with a < b not adjacent."""
    e, married, n = _parents(edges)
    near = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).repartition(n, "a", "b")
    return married.repartition(n, "a", "b").join(near, ["a", "b"], "left_anti").select("a", "c", "b")


def moral_graph(edges: DataFrame) -> DataFrame:
    """a < b: adjacent, or parents of the same node."""
    e, married, n = _parents(edges)
    near = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return near.unionByName(married.select("a", "b")).repartition(n, "a", "b").distinct()


def mutilated(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges of the graph after an intervention on the nodes of `targets` (node): none points into them."""
    return edges.join(targets.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def d_separated(edges: list[tuple], x, y, given: set) -> bool:
    """On a small DAG: x and y are cut in the moral graph of the ancestors of x, y and given, without given."""
    parents: dict = {}
    for a, b in edges:
        parents.setdefault(b, set()).add(a)
    keep, todo = set(), [x, y, *given]
    while todo:
        v = todo.pop()
        if v not in keep:
            keep.add(v)
            todo += parents.get(v, ())
    near: dict = {v: set() for v in keep}
    for child in keep:
        family = [*(parents.get(child, set()) & keep), child]
        for a in family:
            near[a] |= set(family) - {a}
    seen, todo = set(), [x]
    while todo:
        v = todo.pop()
        if v == y:
            return False
        if v not in seen and v not in given:
            seen.add(v)
            todo += near[v] - given
    return True


def backdoor_sets(edges: list[tuple], x, y, most: int | None = None) -> list[tuple]:
    """Adjustment sets (of at most `most` nodes), smallest first, on a small DAG."""
    from itertools import combinations

    children: dict = {}
    for a, b in edges:
        children.setdefault(a, set()).add(b)
    below, todo = set(), [x]
    while todo:
        for v in children.get(todo.pop(), ()):
            if v not in below:
                below.add(v)
                todo.append(v)
    nodes = sorted({v for e in edges for v in e} - {x, y} - below)
    cut = [(a, b) for a, b in edges if a != x]
    return [z for k in range((len(nodes) if most is None else most) + 1) for z in combinations(nodes, k) if d_separated(cut, x, y, set(z))]
