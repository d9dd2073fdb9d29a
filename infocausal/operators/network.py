"""Further network measures. Data-sized graphs run as joins; exact path and flow searches take a graph
of variables or series, whose size is that of the model, as a list of edges."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.scratch import materialize


def label_propagation(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, community, settled: each node takes the most frequent label around it, ties to the smallest.

    Rounds go on until no label changes; after `rounds` of them (labels can swap for ever) settled is false.
    """
    e = edges.filter("src != dst").select("src", "dst").unionByName(edges.filter("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = materialize(e, "both")
    labels = e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for i in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst", "community").agg(F.count("*").alias("n"))
        new = votes.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community"))
        new = materialize(new, "labels")
        if i and new.join(labels, ["node", "community"], "left_anti").isEmpty():
            return labels.withColumn("settled", F.lit(True))
        labels = new
    return labels.withColumn("settled", F.lit(False))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    c = communities.select("node", "community")
    j = edges.join(c.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    inside = j.groupBy("cs", "cd").agg(F.count("*").alias("m"))
    inside = inside.crossJoin(F.broadcast(inside.agg(F.sum("m").alias("all"))))  # one row
    out = inside.groupBy(F.col("cs").alias("c")).agg(F.sum("m").alias("o"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("m")).otherwise(0)).alias("in"), F.first("all").alias("all"))
    into = inside.groupBy(F.col("cd").alias("c")).agg(F.sum("m").alias("i"))
    q = out.join(into, "c", "left").select((F.col("in") / F.col("all") - F.col("o") * F.coalesce("i", F.lit(0)) / (F.col("all") * F.col("all"))).alias("q"))
    return q.agg(F.sum("q").alias("modularity"))


def dyads(edges: DataFrame) -> DataFrame:
    """mutual and one-way pairs."""
    u = edges.filter("src != dst").select("src", "dst").distinct().groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    return u.agg(F.sum((F.col("n") == 2).cast("long")).alias("mutual"), F.sum((F.col("n") == 1).cast("long")).alias("one_way"))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the out-degree of the source with the in-degree of the target over edges."""
    e = edges.select("src", "dst")
    o = e.groupBy("src").agg(F.count("*").alias("o"))
    i = e.groupBy("dst").agg(F.count("*").alias("i"))
    return e.join(o, "src").join(i, "dst").agg(F.corr(F.col("o").cast("double"), F.col("i").cast("double")).alias("assortativity"))


def _out(edges: list[tuple]) -> dict:
    out: dict = {}
    for a, b, *_ in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    return out


def betweenness(edges: list[tuple]) -> dict:
    """Shortest-path betweenness of a small directed graph, unscaled: paths are counted forward, shares summed back."""
    out = _out(edges)
    score = dict.fromkeys(out, 0.0)
    for s in out:
        hops, paths, order, todo = {s: 0}, {s: 1}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out[v]:
                if w not in hops:
                    hops[w], paths[w] = hops[v] + 1, 0
                    todo.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in out[v] if hops.get(w) == hops[v] + 1)
            if v != s:
                score[v] += share[v]
    return score


def directed_paths(edges: list[tuple], x, y, most: float = float("inf")) -> list[tuple]:
    """Simple directed paths in order of their nodes' names; `most` is a limit of the report."""
    out, found, todo = _out(edges), [], [(x,)]
    while todo and len(found) < most:
        p = todo.pop()
        if p[-1] == y:
            found.append(p)
        else:
            todo += [(*p, w) for w in sorted(out.get(p[-1], ()), reverse=True) if w not in p]
    return found


def max_flow(edges: list[tuple], source, sink) -> float:
    """Edges with capacities on a small graph; shortest augmenting paths."""
    room: dict = {}
    for a, b, c in edges:
        room.setdefault(a, {})[b] = room.setdefault(a, {}).get(b, 0) + c
        room.setdefault(b, {}).setdefault(a, 0)
    total = 0.0
    while True:
        back, todo = {source: None}, deque([source])
        while todo and sink not in back:
            v = todo.popleft()
            for w, c in room.get(v, {}).items():
                if c > 1e-12 and w not in back:
                    back[w] = v
                    todo.append(w)
        if sink not in back:
            return total
        step, v = float("inf"), sink
        while back[v] is not None:
            step, v = min(step, room[back[v]][v]), back[v]
        v = sink
        while back[v] is not None:
            room[back[v]][v] -= step
            room[v][back[v]] += step
            v = back[v]
        total += step


def topological(edges: list[tuple]) -> list | None:
    """Nodes with causes first, by name among equals; None if there is a cycle."""
    out, into = _out(edges), {}
    for _, b, *_ in edges:
        into[b] = into.get(b, 0) + 1
    ready, order = sorted(v for v in out if not into.get(v)), []
    while ready:
        v = ready.pop(0)
        order.append(v)
        for w in out[v]:
            into[w] -= 1
            if not into[w]:
                ready = sorted([*ready, w])
    return order if len(order) == len(out) else None


def path_effect(weights: dict[tuple, float], x, y) -> float:
    """Total effect of x on y in a linear model: products of coefficients summed over directed paths."""
    order = topological(list(weights)) or []
    gain = {x: 1.0}
    for v in order:
        if v != x:
            gain[v] = sum(gain.get(a, 0.0) * w for (a, b), w in weights.items() if b == v)
    return gain.get(y, 0.0)
