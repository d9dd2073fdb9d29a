"""Communities by modularity, and matching on several covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.operators.nearest import nearest_within
from infocausal.scratch import materialize


def _moves(links: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """node, community after one round in which half of the nodes (a hash of node and turn decides) move to the neighbour community that gains most."""
    degree = links.groupBy("src").agg(F.sum("w").alias("k"))
    known = materialize(labels.join(degree.withColumnRenamed("src", "node"), "node"), "known")
    sums = known.groupBy("community").agg(F.sum("k").alias("s"))
    to = links.filter("src != dst").join(known.select(F.col("node").alias("dst"), F.col("community").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
    x = known.join(to, "node").join(sums.select(F.col("community").alias("to"), "s"), "to")
    own = F.col("to") == F.col("community")
    gain = F.col("w") - F.col("k") * (F.col("s") - F.when(own, F.col("k")).otherwise(0)) / total
    best = x.groupBy("node").agg(
        F.max(F.struct(F.round(gain, 9).alias("g"), (-F.col("to")).alias("to"))).alias("b"), F.max(F.when(own, F.round(gain, 9))).alias("stay"), F.first("k").alias("k"), F.first("community").alias("community")
    )
    alone = sums.select("community", "s")
    best = best.join(alone, "community").withColumn("stay", F.coalesce("stay", F.round(-F.col("k") * (F.col("s") - F.col("k")) / total, 9)))
    chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    moved = best.select("node", F.when(chosen & (F.col("b.g") > F.col("stay")), -F.col("b.to")).otherwise(F.col("community")).alias("community"))
    rest = labels.join(moved.select("node"), "node", "left_anti")
    return moved.unionByName(rest)


def weighted_modularity(links: DataFrame, labels: DataFrame) -> float:
    """Of links (src, dst, w) with both directions of every edge."""
    j = links.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    c = j.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("i"))
    r = c.agg(F.sum("k").alias("m"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("k2")).first()
    return 0.0 if not r["m"] else float(r["i"] / r["m"] - r["k2"] / r["m"] ** 2)


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 10) -> DataFrame:
    """node, community (a number of the smallest node met): rounds of local moves by joins, then communities become nodes, until modularity rises no more.

    edges: src, dst (numbers) and perhaps w. Half of the nodes move at a time, so that two neighbours seldom
    swap for ever; a round that lowers modularity is not kept. The driver sees one number a round.
    """
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.filter("src != dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    links = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "links")
    total = links.agg(F.sum("w")).first()[0] or 1.0
    part = materialize(links.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "part")
    best = weighted_modularity(links, part)
    for _ in range(levels):
        labels = materialize(links.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
        start, idle = best, 0
        for turn in range(rounds):
            new = materialize(_moves(links, labels, total, turn), "labels")
            q = weighted_modularity(links, new)
            if q > best + 1e-9:
                best, labels, idle = q, new, 0
            else:
                idle += 1
                if idle == 4:
                    break
        if best <= start + 1e-9:
            break
        part = materialize(part.join(labels.select(F.col("node").alias("community"), F.col("community").alias("up")), "community", "left").select("node", F.coalesce("up", "community").alias("community")), "part")
        a, b = (labels.select(F.col("node").alias(s), F.col("community").alias(f"c{s}")) for s in ("src", "dst"))
        links = materialize(links.join(a, "src").join(b, "dst").groupBy(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).agg(F.sum("w").alias("w")), "links")
    name = part.groupBy("community").agg(F.min("node").alias("name"))
    return part.join(name, "community").select("node", F.col("name").alias("community"))


def edge_betweenness(edges: list[tuple]) -> dict[tuple, float]:
    """Shares of shortest paths over each edge of a small directed graph: paths are counted forward, shares summed back."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    score = dict.fromkeys(edges, 0.0)
    for s in out:
        hops, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in out[v]:
                if w not in hops:
                    hops[w], paths[w] = hops[v] + 1, 0
                    order.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        ends = dict.fromkeys(order, 1.0)
        for v in reversed(order):
            for w in out[v]:
                if hops[w] == hops[v] + 1:
                    part = paths[v] / paths[w] * ends[w]
                    score[v, w] += part
                    ends[v] += part
    return score


def girvan_newman(edges: list[tuple], parts: int) -> list[frozenset]:
    """Components after the undirected edge with most shortest paths is cut, again and again, until there are so many; a small graph."""
    left = {frozenset(e) for e in edges}
    nodes = sorted({v for e in edges for v in e}, key=str)

    def components() -> list[frozenset]:
        seen, out = set(), []
        for v in nodes:
            if v in seen:
                continue
            group, todo = set(), [v]
            while todo:
                u = todo.pop()
                if u not in group:
                    group.add(u)
                    todo += [w for e in left if u in e for w in e - {u}]
            seen |= group
            out.append(frozenset(group))
        return out

    while len(found := components()) < parts and left:
        both = [(a, b) for e in left for a, b in (tuple(e), tuple(e)[::-1])]
        score = edge_betweenness(both)
        worst = max(left, key=lambda e: (round(sum(score[x] for x in (tuple(e), tuple(e)[::-1])), 9), sorted(map(str, e))))
        left.discard(worst)
    return found


def caliper_match(df: DataFrame, xs: list[str], key: str, caliper: float) -> DataFrame:
    """key, match, distance, y, y_match: each treated row with the control nearest in the standardised covariates, if within `caliper`; ties to the smaller key.

    The search goes from small cells to the caliper (nearest_within).
    """
    moments = df.agg(*[f(F.col(x).cast("double")).alias(f"{n}_{x}") for x in xs for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = df.crossJoin(F.broadcast(moments))  # one row
    z = z.select("t", "y", F.col(key).alias("k"), *[((F.col(x) - F.col(f"m_{x}")) / F.coalesce(F.nullif(F.col(f"s_{x}"), F.lit(0.0)), F.lit(1.0))).alias(f"z{i}") for i, x in enumerate(xs)])
    at = [f"z{i}" for i in range(len(xs))]
    z = z.na.drop(subset=at)
    best = nearest_within(z.filter("t = 1").select("k", "y", *at), z.filter("t = 0").select(F.col("k").alias("match"), F.col("y").alias("y_match"), *at), at, caliper, "match")
    return best.select(F.col("k").alias(key), "match", "distance", "y", "y_match")


def matched_effect(matches: DataFrame, n_treated: int | None = None) -> DataFrame:
    """att, se (of paired differences), n, and the share of the treated that has a match."""
    d = F.col("y") - F.col("y_match")
    s = matches.agg(F.avg(d).alias("att"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return s if n_treated is None else s.withColumn("share", F.col("n") / n_treated)
