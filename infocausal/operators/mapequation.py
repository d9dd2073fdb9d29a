"""Communities by the map equation: the fewest nats a step in which a walk over the graph can be told, with a codebook a module and one for moving between them.

Flow is by link, in buckets of one end, so that joins with the labels of that end move labels only.
Modules know their flow in, out and inside. Local moves are joins of nodes with the modules of their
neighbours, half of the nodes at a time, and only links to that half are sent; a round that doesn't
shorten the code isn't kept, and smaller shares of the nodes are tried. Rounds go on until all shares
in turn have nothing to gain. Then modules become nodes, until nothing is gained. The driver sees a
few numbers a round. Tasks are as many as the links need, so what one of them sorts doesn't grow.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.scratch import bucketed, free_shuffles, materialize, tasks_for


def _links(edges: DataFrame) -> DataFrame:
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w")).na.drop().filter("src != dst and w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def link_flow(edges: DataFrame, directed: bool = False, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """src, dst, f: the share of steps that go along each link. Undirected links are walked both ways in proportion to weight;
    directed ones by the rank of their source (with jumps, which are not steps of the code). Loops are left out."""
    e = _links(edges)
    spark = e.sparkSession
    if not directed:
        e = materialize(e, "links")
        n = tasks_for(spark, 2 * e.count())
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        both = bucketed(both.repartition(n, "src").groupBy("src", "dst").agg(F.sum("w").alias("w")), "links", n, "src")
        total = 2 * (e.agg(F.sum("w")).first()[0] or 0.5)
        return both.select("src", "dst", (F.col("w") / total).alias("f"))
    share = materialize(e.join(e.groupBy("src").agg(F.sum("w").alias("k")), "src").select("src", "dst", (F.col("w") / F.col("k")).alias("s")), "shares")
    nodes = materialize(share.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    n = max(nodes.count(), 1)
    rank = nodes.withColumn("r", F.lit(1.0 / n))
    for i in range(rounds):
        given = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("s")).alias("g"))
        rank = nodes.join(given, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if i % 5 == 4:
            rank = materialize(rank, "rank")
    f = materialize(share.join(rank.withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("r") * F.col("s")).alias("f")), "flow")
    total = f.agg(F.sum("f")).first()[0] or 1.0
    return f.withColumn("f", F.col("f") / total)


def plogp(x: Column) -> Column:
    return F.when(x > 1e-15, x * F.log(x)).otherwise(0.0)


def _modules(flow: DataFrame, labels: DataFrame) -> DataFrame:
    """module, p (visits of its nodes), e (flow in), x (flow out); labels: node, module, p."""
    a, b = (labels.select(F.col("node").alias(s), F.col("module").alias(f"m{s}")) for s in ("src", "dst"))
    over = flow.join(a, "src").repartition(tasks_for(flow.sparkSession, flow.count()), "dst").join(b, "dst").filter("msrc != mdst")
    ends = over.select(F.explode(F.array(F.struct(F.col("msrc").alias("module"), F.lit(0.0).alias("e"), F.col("f").alias("x")), F.struct(F.col("mdst").alias("module"), F.col("f").alias("e"), F.lit(0.0).alias("x")))).alias("s")).select("s.*")
    both = ends.withColumn("p", F.lit(0.0)).unionByName(labels.select("module", F.lit(0.0).alias("e"), F.lit(0.0).alias("x"), "p"))
    return both.groupBy("module").agg(*[F.sum(c).alias(c) for c in "pex"])


def _length(modules: DataFrame, nodes_part: float) -> float:
    r = modules.agg(F.sum("e").alias("e"), F.sum(plogp(F.col("e"))).alias("le"), F.sum(plogp(F.col("x"))).alias("lx"), F.sum(plogp(F.col("x") + F.col("p"))).alias("lxp")).first()
    e = r["e"] or 0.0
    return (e * math.log(e) if e > 1e-15 else 0.0) - (r["le"] or 0.0) - (r["lx"] or 0.0) + (r["lxp"] or 0.0) - nodes_part


def visits(flow: DataFrame) -> DataFrame:
    """node, p: the share of steps that end at each node."""
    into = flow.groupBy(F.col("dst").alias("node")).agg(F.sum("f").alias("p"))
    return flow.select(F.col("src").alias("node")).distinct().join(into, "node", "full").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))


def code_length(flow: DataFrame, labels: DataFrame) -> float:
    """Nats a step for the modules of labels (node, module)."""
    p = visits(flow).join(labels.select("node", "module"), "node")
    return _length(_modules(flow, p), float(p.agg(F.sum(plogp(F.col("p")))).first()[0] or 0.0))


def _neighbours(flow: DataFrame, directed: bool) -> DataFrame:
    """o, node, out (node to o) and, if directed, into (o to node), in buckets of o; without a direction both are the same."""
    if not directed:
        return flow.select(F.col("src").alias("o"), F.col("dst").alias("node"), F.col("f").alias("out"))
    each = flow.select(F.col("dst").alias("o"), F.col("src").alias("node"), F.col("f").alias("out"), F.lit(0.0).alias("into")).unionByName(
        flow.select(F.col("src").alias("o"), F.col("dst").alias("node"), F.lit(0.0).alias("out"), F.col("f").alias("into")))
    n = tasks_for(flow.sparkSession, 2 * flow.count())
    return bucketed(each.repartition(n, "o").groupBy("o", "node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")), "neighbours", n, "o")


def _into(links: DataFrame) -> Column:
    return F.col("into" if "into" in links.columns else "out")


def _paired(links: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Each linked pair of nodes once: mo and module (theirs), out (from the one of `module`), into."""
    a = labels.select(F.col("node").alias("o"), F.col("module").alias("mo"))
    own = [c for c in ("out", "into") if c in links.columns]
    sent = links.filter("o < node").join(a, "o").select("node", "mo", *own).repartition(n, "node")
    return sent.join(labels.select("node", "module"), "node").select("mo", "module", "out", _into(links).alias("into"))


def _rated(links: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """As _modules, for labels of all nodes with their flow: what leaves a module is its nodes' flow less what stays inside."""
    inside = _paired(links, labels, n).filter("mo = module").groupBy("module").agg(F.sum(F.col("out") + F.col("into")).alias("i"))
    m = labels.groupBy("module").agg(*[F.sum(c).alias(c) for c in ("p", "all_out", "all_into")]).join(inside, "module", "left").na.fill(0.0, ["i"])
    return m.select("module", "p", (F.col("all_into") - F.col("i")).alias("e"), (F.col("all_out") - F.col("i")).alias("x"))


#: Nats a step under which a round's moves are not worth it; sums over modules are exact to some thousandths of it.
GAIN = 1e-9
#: Modules up to which their flows go to all tasks; those of more modules go along with the links.
FEW = 20_000


def _moved(links: DataFrame, labels: DataFrame, modules: DataFrame, sweep: int, share: int, shares: int, n: int) -> DataFrame:
    """labels after the nodes of a share went where their own move shortens the code most; gain: what each alone changes (null: stays)."""
    directed = "into" in links.columns
    mine = F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(shares)) == share
    state = labels.join(modules.withColumnsRenamed({"p": "mp", "e": "me", "x": "mx"}), "module")
    # Without a direction as much goes in as out.
    given = ["np", "nx", *(["ne"] if directed else [])]
    ways = ["out", *(["into"] if directed else [])]
    flows = lambda f: [F.col(f"{f}{c[1]}").alias(c) for c in given]
    if modules.count() <= FEW:
        sent = links.filter(mine).join(labels.select(F.col("node").alias("o"), F.col("module").alias("to")), "o").select("node", "to", *ways).repartition(n, "node")
        to = sent.groupBy("node", "to").agg(*[F.sum(c).alias(c) for c in ways]).join(F.broadcast(modules.select(F.col("module").alias("to"), *flows(""))), "to")
    else:
        at = state.select(F.col("node").alias("o"), F.col("module").alias("to"), *flows("m"))
        sent = links.filter(mine).join(at, "o").select("node", "to", *ways, *given).repartition(n, "node")
        to = sent.groupBy("node", "to").agg(*[F.sum(c).alias(c) for c in ways], *[F.first(c).alias(c) for c in given])
    if not directed:
        to = to.withColumns({"into": F.col("out"), "ne": F.col("nx")})
    w = Window.partitionBy("node")
    own = lambda c: F.coalesce(F.max(F.when(F.col("to") == F.col("module"), F.col(c))).over(w), F.lit(0.0))
    c = state.filter(mine).join(to, "node").withColumns({"own_out": own("out"), "own_into": own("into")}).filter("to != module")
    total = modules.agg(F.sum("e")).first()[0] or 0.0
    col = F.col
    x1 = col("mx") - (col("all_out") - col("own_out")) + col("own_into")
    e1 = col("me") - (col("all_into") - col("own_into")) + col("own_out")
    x2 = col("nx") + (col("all_out") - col("out")) - col("into")
    e2 = col("ne") + (col("all_into") - col("into")) - col("out")
    change = lambda new, old: plogp(new) - plogp(old)
    gain = (
        change(F.lit(total) + e1 - col("me") + e2 - col("ne"), F.lit(total)) - change(e1, col("me")) - change(e2, col("ne")) - change(x1, col("mx")) - change(x2, col("nx"))
        + change(x1 + col("mp") - col("p"), col("mx") + col("mp")) + change(x2 + col("np") + col("p"), col("nx") + col("np"))
    )
    # Rounded as a part of the node's flow, which is less the more nodes there are.
    part = F.round(gain / (col("all_out") + col("all_into")), 8)
    best = c.select("node", "to", gain.alias("gain"), part.alias("g")).groupBy("node").agg(F.min(F.struct("g", "to", "gain")).alias("b")).filter(col("b.g") < 0)
    return labels.join(best, "node", "left").select("node", F.coalesce("b.to", "module").alias("module"), "p", "all_out", "all_into", "b.gain")


def _merged(links: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The links between modules, as links of nodes."""
    col = F.col
    ends = [F.struct(col(a).alias("o"), col(b).alias("node"), col(out).alias("out"), col(into).alias("into")) for a, b, out, into in (("mo", "module", "out", "into"), ("module", "mo", "into", "out"))]
    each = _paired(links, labels, n).filter("mo != module").select(F.explode(F.array(*ends)).alias("s")).select("s.o", "s.node", *[f"s.{c}" for c in ("out", "into") if c in links.columns])
    return bucketed(each.repartition(n, "o").groupBy("o", "node").agg(*[F.sum(c).alias(c) for c in each.columns[2:]]), "merged", n, "o")


def infomap(edges: DataFrame, directed: bool = False, rounds: int | None = None, levels: int | None = None) -> DataFrame:
    """node, module (the smallest node of it): nodes are moved until no share's moves shorten the code, then their modules, until nothing is gained.

    rounds of a level (each share of the nodes once) and levels are as many as that takes, unless a caller bounds them. An empty graph has no rows.
    """
    flow = link_flow(edges, directed)
    links = _neighbours(flow, directed)
    spark = links.sparkSession
    n = tasks_for(spark, links.count())
    # From the side of o: what a neighbour takes in is what o gives.
    ends = links.groupBy(F.col("o").alias("node")).agg(F.sum(_into(links)).alias("all_out"), F.sum("out").alias("all_into"))
    labels = materialize(ends.select("node", F.col("node").alias("module"), F.col("all_into").alias("p"), "all_out", "all_into"), "labels")
    part = labels.select("node", "module")
    constant = float(labels.agg(F.sum(plogp(F.col("p")))).first()[0] or 0.0)
    modules = labels.select("module", "p", F.col("all_into").alias("e"), F.col("all_out").alias("x"))
    best = _length(modules, constant)
    for level in count() if levels is None else range(levels):
        start, shares = best, 2
        for sweep in count() if rounds is None else range(rounds):
            gained = clashed = False
            for share in range(shares):
                new = materialize(_moved(links, labels, modules, sweep, share, shares, n), "labels")
                if -(new.agg(F.sum("gain")).first()[0] or 0.0) < GAIN:
                    continue
                new = new.drop("gain")
                m = materialize(_rated(links, new, n), "modules")
                length = _length(m, constant)
                if length < best - GAIN / 10:
                    best, labels, modules, gained = length, new, m, True
                else:
                    clashed = True
            if not (gained or clashed):
                break
            shares *= 2 if clashed else 1
            free_shuffles(spark)
        if best >= start - GAIN / 10:
            break
        part = materialize(part.join(labels.select(F.col("node").alias("module"), F.col("module").alias("up")), "module").select("node", F.col("up").alias("module")), "part")
        if levels is None or level + 1 < levels:
            links = _merged(links, labels, n)
            n = tasks_for(spark, links.count())
            labels = modules.select(F.col("module").alias("node"), "module", "p", F.col("x").alias("all_out"), F.col("e").alias("all_into"))
    name = part.groupBy("module").agg(F.min("node").alias("name"))
    return part.join(name, "module").select("node", F.col("name").alias("module"))
