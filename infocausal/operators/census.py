"""The sixteen kinds of three nodes in a directed graph, and counts against graphs with the same degrees.

Open shapes are counted from each node's numbers of outgoing, incoming and mutual links, so a hub
costs a row and not its pairs of neighbours; only triangles are made, from their smaller ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.scratch import drop_unread, free_shuffles, materialize, tables, tasks_for


def dyads(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, a, b, d for linked pairs a < b: 1 a -> b, 2 b -> a, 3 both. Loops and repeated edges are left out."""
    e = edges.filter("src != dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("d"))
    return e.distinct().groupBy(*by, "a", "b").agg(F.sum("d").cast("int").alias("d"))


def _turned(d):
    return F.when(d == 3, 3).otherwise(3 - d)


#: Words of 64 bits in a node's filter of the nodes that it leads to.
WORDS = 4


def _place(v: Column) -> tuple[Column, Column]:
    """The word and the bit of a node in a filter."""
    place = F.pmod(F.xxhash64(v), F.lit(64 * WORDS)).cast("int")
    return F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)


#: A node with over so many times the mean number of links is placed by it; the others are few enough to be placed by name.
HEAVY = 4


def _ends(links: DataFrame) -> DataFrame:
    """v, k: the nodes and their numbers of rows."""
    return links.select(F.explode(F.array(*links.columns[:2])).alias("v")).groupBy("v").agg(F.count("*").alias("k"))


def triangles(pairs: DataFrame, by: tuple[str, ...] = (), ends: DataFrame | None = None) -> DataFrame:
    """by, a, b, c, ab, bc, ac (each dyad as seen from its first node) of all linked triples.

    pairs may have a mutual link as one row (3) or two (1 and 2). They are led from the end with fewer links (those of
    `ends`: v, k; any order gives the same triples), so a hub's own list is short. A node's list goes to each node on it,
    less what comes before that one. There the node's filter is asked for the others first, and its own list then; what
    is shuffled follows the lists, and open pairs of links are never written.
    """
    by, spark = list(by), pairs.sparkSession
    ends = materialize(_ends(pairs.select("a", "b")) if ends is None else ends, "ends")
    heavy = materialize(ends.filter(F.col("k") > HEAVY * (ends.agg(F.avg("k")).first()[0] or 0.0)), "heavy")
    one = pairs.join(heavy.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a", "left").join(heavy.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b", "left").na.fill(0, ["ka", "kb"])
    small = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    turn = lambda x, y: F.when(small, x).otherwise(y)
    led = one.select(*by, turn(F.col("a"), F.col("b")).alias("u"), turn(F.col("b"), F.col("a")).alias("v"), turn(F.col("d"), _turned(F.col("d"))).cast("byte").alias("d"), turn(F.col("kb"), F.col("ka")).alias("k"))
    led = led.repartition(tasks_for(spark, pairs.count()), *by, "u").groupBy(*by, "u", "v").agg(F.bit_or("d").alias("d"), F.max("k").alias("k"))
    word, bit = _place(F.col("v"))
    leads = F.array(*[F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(WORDS)])
    led = led.groupBy(*by, "u").agg(F.sort_array(F.collect_list(F.struct("k", "v", "d"))).alias("l"), leads.alias("m"))
    led = materialize(led.select(*by, "u", F.col("l.v").alias("vs"), F.col("l.d").alias("ds"), "m"), "led")
    rest = lambda c: F.slice(c, F.col("i") + 2, F.size(c))
    sent = led.select(*by, "u", "vs", "ds", F.posexplode("vs").alias("i", "x")).filter(F.col("i") + 1 < F.size("vs"))
    sent = sent.select(*by, "u", "x", F.get("ds", F.col("i")).alias("ux"), rest("vs").alias("ys"), rest("ds").alias("us"))
    met = sent.join(led.select(*by, F.col("u").alias("x"), "vs", "ds", "m").hint("shuffle_hash"), [*by, "x"]).select("*", F.posexplode("ys").alias("j", "y"))
    word, bit = _place(F.col("y"))
    at = F.array_position("vs", F.col("y"))
    t = met.filter((F.get("m", word).bitwiseAND(bit) != 0) & (at > 0))
    return t.select(*by, F.col("u").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), F.col("ux").cast("int").alias("ab"), F.get("ds", (at - 1).cast("int")).cast("int").alias("bc"), F.get("us", F.col("j")).cast("int").alias("ac"))


def _closed_kind():
    """The class of three linked nodes from the dyads ab, bc, ac."""
    mutual = sum((F.col(c) == 3).cast("int") for c in ("ab", "bc", "ac"))
    # How the node that faces a mutual dyad points at both its ends: 1 at both, 2 from both, else mixed.
    facing = lambda one, two: F.when((one == 1) & (two == 1), "120D").when((one == 2) & (two == 2), "120U").otherwise("120C")
    ab, bc, ac = F.col("ab"), F.col("bc"), F.col("ac")
    one = F.when(ab == 3, facing(_turned(ac), _turned(bc))).when(bc == 3, facing(ab, ac)).otherwise(facing(_turned(ab), bc))
    round_ = ((ab == 1) & (bc == 1) & (ac == 2)) | ((ab == 2) & (bc == 2) & (ac == 1))
    return F.when(mutual == 3, "300").when(mutual == 2, "210").when(mutual == 1, one).otherwise(F.when(round_, "030C").otherwise("030T"))


#: The class of an open pair of links by how the middle node sees both: o out, i in, m mutual.
OPEN = {"oo": "021D", "ii": "021U", "io": "021C", "im": "111D", "mo": "111U", "mm": "201"}


def triad_census(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """kind, n for all sixteen classes; nodes (node): all nodes, by default those with an edge."""
    pairs = materialize(dyads(edges), "dyads")
    total = (pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct() if nodes is None else nodes.select("node").distinct()).count()
    closed = materialize(triangles(pairs).withColumn("kind", _closed_kind()), "triangles")
    # Each node's links as it sees them, and the pairs of them that a triangle closes.
    seen = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("d").alias("d")), F.struct(F.col("b").alias("v"), _turned(F.col("d")).alias("d")))).alias("x")).select("x.*")
    count = lambda k: F.sum((F.col("d") == k).cast("long"))
    at = seen.groupBy("v").agg(count(1).alias("o"), count(2).alias("i"), count(3).alias("m"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    many = {"oo": two("o"), "ii": two("i"), "mm": two("m"), "io": F.col("o") * F.col("i"), "im": F.col("i") * F.col("m"), "mo": F.col("o") * F.col("m")}
    letter = lambda d: F.when(d == 1, "o").when(d == 2, "i").otherwise("m")
    ab, bc, ac = F.col("ab"), F.col("bc"), F.col("ac")
    corner = lambda p, q: F.array_join(F.array_sort(F.array(letter(p), letter(q))), "")
    corners = closed.select(F.explode(F.array(corner(ab, ac), corner(_turned(ab), bc), corner(_turned(ac), _turned(bc)))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    shut = {r["k"]: r["n"] for r in corners.collect()}  # six rows
    row = at.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in many.items()]).first()
    found = {OPEN[k]: row[k] - shut.get(k, 0) for k in many}
    # A pair and a node that neither is linked to: all others, less both ends' links, those of both counted once.
    degree = at.select("v", (F.col("o") + F.col("i") + F.col("m")).alias("k"))
    p = pairs.join(degree.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b")
    alone = {r["mutual"]: r["n"] for r in p.groupBy((F.col("d") == 3).alias("mutual")).agg(F.sum(total - F.col("ka") - F.col("kb")).alias("n")).collect()}
    both = closed.agg(*[F.coalesce(F.sum(sum((c == 3).cast("long") if m else (c != 3).cast("long") for c in (ab, bc, ac))), F.lit(0)).alias(f"s{int(m)}") for m in (False, True)]).first()
    found |= {"012": alone.get(False, 0) + both["s0"], "102": alone.get(True, 0) + both["s1"]}
    found |= dict.fromkeys(("030T", "030C", "120D", "120U", "120C", "210", "300"), 0) | {r["kind"]: r["n"] for r in closed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    found["003"] = total * (total - 1) * (total - 2) // 6 - sum(found.values())
    return edges.sparkSession.createDataFrame(sorted((k, int(n)) for k, n in found.items()), "kind string, n long")


def _digits(of: Column, tag: str) -> Column:
    """Eight hexadecimal digits that a hash of the text decides; as text they have the order of their numbers."""
    return F.substring(F.md5(F.concat(of, F.lit(f"|{tag}"))), 1, 8)


def _unit(digits: Column) -> Column:
    """From 0 to 1."""
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def rewired(edges: DataFrame, replicates: int, rounds: int, seed: int = 1) -> DataFrame:
    """rep, src, dst: graphs in which every node has as many edges in and out as before, by rounds of swaps of two edges' ends.

    In a round edges meet by chance in small boxes, and the two with the smallest numbers of a box
    swap their ends if that makes no loop, no edge that is there, and none that another swap makes.
    An edge keeps its start, so a round deals the edges to boxes once, and once more what is there
    and what would be made by both ends; the few boxes whose swaps clash are then joined to the edges.
    """
    own = len(tables)
    g = _rewired(materialize(edges.filter("src != dst").select("src", "dst").distinct(), "edges"), replicates, rounds, seed)
    _keep_only(g, own)
    return g


def _keep_only(last: DataFrame, own: int, *others: DataFrame) -> None:
    """Of the tables made since there were `own`, only those that are read stay; the shuffles of the others' plans go as well."""
    made = tables[own:]
    drop_unread(last.sparkSession, made, [last, *others])
    tables[own:] = made
    free_shuffles(last.sparkSession)


def _rewired(base: DataFrame, replicates: int, rounds: int, seed: int) -> DataFrame:
    spark, own, size = base.sparkSession, len(tables), base.count()
    boxes, n = max(size // 3, 1), tasks_for(base.sparkSession, size * replicates)
    g = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rep = F.expr(f"cast(box div {boxes} as int)").alias("rep")
    w = Window.partitionBy("box").orderBy("u", "src", "dst")
    for i in range(rounds):
        key = F.concat_ws("|", *[c.cast("string") for c in (F.lit(seed), F.lit(i), F.col("rep"), F.col("src"), F.col("dst"))])
        # A box's number has the replicate in it.
        box = F.col("rep") * F.lit(boxes).cast("long") + F.floor(_unit(_digits(key, "box")) * boxes)
        met = g.select(box.alias("box"), _digits(key, "order").alias("u"), "src", "dst").repartition(n, "box")
        met = met.select("box", "src", "dst", F.row_number().over(w).alias("k"), *[f(c).over(w).alias(f"{t}_{c}") for t, f in (("next", F.lead), ("last", F.lag)) for c in ("src", "dst")])
        other = {c: F.when(F.col("k") == 1, F.col(f"next_{c}")).when(F.col("k") == 2, F.col(f"last_{c}")) for c in ("src", "dst")}
        may = (F.col("src") != other["dst"]) & (F.col("dst") != other["src"]) & (F.col("src") != other["src"]) & (F.col("dst") != other["dst"])
        boxed = materialize(met.select("box", "src", "dst", F.when(may, other["dst"]).alias("new")), "boxed")
        _keep_only(boxed, own)
        made = boxed.filter("new is not null").select("box", rep, "src", F.col("new").alias("dst"), F.lit(1).alias("made"))
        ends = boxed.select("box", rep, "src", "dst", F.lit(0).alias("made")).unionByName(made).withColumn("h", F.xxhash64("rep", "src", "dst"))
        clash = lambda of, *by: of.groupBy(*by).agg(F.sum("made").alias("m"), F.count("*").alias("n")).filter("m > 0 and n > 1").select(*by)
        # Only the ends of like hash, some of the true ones at most times, are compared.
        like = materialize(clash(ends.select("h", "made").repartition(n, "h"), "h"), "like")
        like = materialize(ends.join(like, "h", "left_semi"), "like")
        key = ["rep", "src", "dst"]
        bad = materialize(like.filter("made = 1").join(clash(like, *key), key, "left_semi").select("box").distinct(), "bad")
        g = boxed.join(bad.withColumn("bad", F.lit(True)), "box", "left").select(rep, "src", F.when(F.col("bad").isNull(), F.col("new")).alias("new"), "dst").select("rep", "src", F.coalesce("new", "dst").alias("dst"))
    g = materialize(g.select("rep", "src", "dst"), "rewired")
    _keep_only(g, own)
    return g


def motif_scores(edges: DataFrame, replicates: int = 10, rounds: int = 10, seed: int = 1) -> DataFrame:
    """kind, n, mean, sd, z of the linked triples by class, against graphs with the same degrees."""
    by = ("rep",)
    base = materialize(edges.filter("src != dst").select("src", "dst").distinct(), "edges")
    own = base.select(F.lit(-1).alias("rep"), "src", "dst").unionByName(_rewired(base, replicates, rounds, seed).select(F.col("rep").cast("int").alias("rep"), "src", "dst"))
    pairs = own.select("rep", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("d"))
    # Degrees are the same in all the graphs.
    counts = triangles(pairs, by, _ends(base)).withColumn("kind", _closed_kind()).groupBy("rep", "kind").agg(F.count("*").alias("n"))
    c, zero = F.col("n"), F.col("rep") < 0
    s = counts.groupBy("kind").agg(
        F.coalesce(F.sum(F.when(zero, c)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~zero, c)), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.when(~zero, c * c)), F.lit(0)).alias("s2"))
    mean = F.col("s1") / replicates
    sd = F.sqrt(F.greatest((F.col("s2") - F.col("s1") * mean) / (replicates - 1), F.lit(0.0)))
    return s.select("kind", "n", mean.alias("mean"), sd.alias("sd"), ((F.col("n") - mean) / F.nullif(sd, F.lit(0.0))).alias("z"))
