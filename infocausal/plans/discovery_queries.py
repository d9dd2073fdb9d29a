"""Structure searches over columns of lineitem, with SQL that scores every graph or tests every pair. Registered with those of catalogue.py."""

from __future__ import annotations

from itertools import combinations, permutations, product

from infocausal.operators import discovery, equivalence, latent
from infocausal.plans.catalogue import query, r6
from infocausal.plans.kernel_queries import LINES, lines
from pyspark.sql import functions as F

# ---------------------------------------------------------------- every graph, scored in SQL


def all_graphs(names: list[str]) -> list[dict[str, tuple]]:
    """Every graph without cycles over the names, as node -> parents."""
    subsets = {v: [c for k in range(len(names)) for c in combinations([w for w in names if w != v], k)] for v in names}
    out = []
    for choice in product(*[subsets[v] for v in names]):
        parents, left = dict(zip(names, choice, strict=True)), set(names)
        while left and (free := {v for v in left if not left & set(parents[v])}):
            left -= free
        if not left:
            out.append(parents)
    return out


def _det(vs: tuple, entry=lambda a, b: f"c_{min(a, b)}_{max(a, b)}") -> str:
    """The determinant of the moments of some columns, term by term."""
    if not vs:
        return "1.0::DOUBLE"
    terms = []
    for order in permutations(range(len(vs))):
        odd = sum(order[i] > order[j] for i, j in combinations(range(len(vs)), 2)) % 2
        terms.append(("-" if odd else "+") + "*".join(entry(vs[i], vs[k]) for i, k in enumerate(order)))
    return "(" + "".join(terms) + ")"


def scored_sql(names: list[str], local: str) -> str:
    """CTEs m (moments of l), s (v, parents, local), g (graph, v, parents) and t (graph, total); local uses {n_parents}, {with_v} and {without} (determinants)."""
    names = sorted(names)
    moments = ", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:])
    rows = " UNION ALL ".join(
        f"SELECT '{v}' AS v, '{','.join(ps)}' AS ps, " + local.format(n_parents=len(ps), with_v=_det(tuple(sorted((*ps, v)))), without=_det(ps)) + " AS local FROM m"
        for v in names for k in range(len(names)) for ps in combinations([w for w in names if w != v], k)
    )
    graphs = ", ".join(f"({i}, '{v}', '{','.join(ps)}')" for i, g in enumerate(all_graphs(names)) for v, ps in g.items())
    return f"""m AS MATERIALIZED (SELECT count(*) AS n, {moments} FROM l), s AS MATERIALIZED ({rows}), g(graph, v, ps) AS (VALUES {graphs}),
t AS MATERIALIZED (SELECT graph, sum(local) AS total FROM g JOIN s USING (v, ps) GROUP BY graph), best AS (SELECT graph FROM t WHERE total > (SELECT max(total) FROM t) - 1e-4),
e AS (SELECT graph, unnest(string_split(ps, ',')) AS a, v AS b FROM g JOIN best USING (graph) WHERE ps <> '')"""


BIC = "-n * ln({with_v} / {without}) - ({n_parents} + 1) * ln(n)"
CLASS_SQL = """SELECT CASE WHEN two THEN least(a, b) ELSE a END AS a, CASE WHEN two THEN greatest(a, b) ELSE b END AS b, NOT two AS directed
FROM (SELECT DISTINCT x.a, x.b, EXISTS (SELECT 1 FROM e y WHERE y.a = x.b AND y.b = x.a) AS two FROM e x) WHERE NOT two OR a < b"""
FOUR = ["d", "e", "q", "u"]
#: u on a log scale, and w, which adds the discount (thirty times, so that both parts vary alike).
PAID = LINES.replace("l_extendedprice / l_quantity AS u", "ln(l_extendedprice / l_quantity) AS u, ln(l_extendedprice / l_quantity) + 30 * l_discount AS w")


def paid(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("u", F.log("u")).withColumn("w", F.col("u") + 30 * F.col("d"))


@query(f"WITH {LINES}, {scored_sql(FOUR, BIC)} {CLASS_SQL}")
def ges_graph(spark, sf_dir):
    """Discount, price, quantity, price of a unit. SQL scores all 543 graphs."""
    return equivalence.ges(spark, lines(spark, sf_dir), FOUR)


@query(f"WITH {PAID}, {scored_sql(['q', 'tax', 'u', 'w'], BIC)} {CLASS_SQL}")
def ges_graph_paid(spark, sf_dir):
    """Quantity, price of a unit and its sum with the tax: a class with links that have no direction."""
    return equivalence.ges(spark, paid(spark, sf_dir), ["tax", "q", "u", "w"])


@query(f"WITH {LINES}, {scored_sql(['e', 'q', 'u'], BIC)} SELECT DISTINCT a, b FROM e")
def greedy_graph(spark, sf_dir):
    """Hill climbing over graphs; SQL scores all 25, of which one is best."""
    return discovery.greedy(spark, lines(spark, sf_dir), ["q", "e", "u"])


GRAPHS = {"chain": {"u": ["q"], "e": ["u"]}, "fork": {"q": ["u"], "e": ["u"]}, "collider": {"u": ["q", "e"]}, "none": {}, "full": {"e": ["q"], "u": ["q", "e"]}}


def _graph_score_sql(graph: dict) -> str:
    """BIC, AIC and BGe of a graph over e, q, u; r_<a>_<b> is the posterior scatter of the BGe score."""
    bic, aic, bge = [], [], []
    for v in ("q", "e", "u"):
        ps = tuple(sorted(graph.get(v, ())))
        k, a = len(ps), 2 + len(ps)
        ratio = f"ln({_det(tuple(sorted((*ps, v))))} / {_det(ps)})"
        bic.append(f"-n * {ratio} - {k + 1} * ln(n)")
        aic.append(f"-n * {ratio} - {2 * (k + 1)}")
        r = lambda vs: _det(vs, lambda x, y: f"r_{min(x, y)}_{max(x, y)}")
        a = 1 + 1 + k + 1
        bge.append(f"0.5 * ln(1.0 / (n + 1)) + lgamma((n + {a}) / 2.0) - lgamma({a} / 2.0) - n / 2.0 * ln(pi()) + {(a + k) / 2} * ln(0.5) + (n + {a} - 1) / 2.0 * ln({r(ps)}) - (n + {a}) / 2.0 * ln({r(tuple(sorted((*ps, v))))})")
    return ", ".join(r6(f"{' + '.join(f'({x})' for x in xs)} AS {name}") for xs, name in ((bic, "bic"), (aic, "aic"), (bge, "bge")))


_THREE = [(a, b) for i, a in enumerate("equ") for b in "equ"[i:]]


@query(f"""WITH {LINES}, m0 AS (SELECT count(*) AS n, {', '.join(f'covar_pop({a}, {b}) AS c_{a}_{b}' for a, b in _THREE)} FROM l WHERE e < 1e12),
m AS (SELECT *, {', '.join(f'n * c_{a}_{b}' + (' + 0.5' if a == b else '') + f' AS r_{a}_{b}' for a, b in _THREE)} FROM m0) """
       + " UNION ALL ".join(f"SELECT '{name}' AS graph, {_graph_score_sql(g).replace('round(', 'round(1e-3 * (').replace(', 6)', '), 4)')} FROM m" for name, g in GRAPHS.items()))
def graph_scores(spark, sf_dir):
    """In thousands, to four places: graphs of one class have one score by BIC and BGe."""
    s = equivalence.graph_scores(spark, lines(spark, sf_dir), ["q", "e", "u"], GRAPHS)
    return s.select("graph", *[(F.round(F.col(c) * 1e-3, 4) + 0.0).alias(c) for c in ("bic", "aic", "bge")])


# ---------------------------------------------------------------- every test, in SQL


def tests_sql(names: list[str], critical: float) -> str:
    """CTEs m (correlations r_<a>_<b>) and i (a, b, given, size, independent): each pair given each set of others, by Fisher's z."""
    names = sorted(names)
    rows = []
    minor = lambda rows_, cols: _minor(rows_, cols)
    for a, b in combinations(names, 2):
        for k in range(len(names) - 1):
            for z in combinations([w for w in names if w not in (a, b)], k):
                rho = f"({minor((a, *z), (b, *z))}) / sqrt(({minor((a, *z), (a, *z))}) * ({minor((b, *z), (b, *z))}))"
                rows.append(f"SELECT '{a}' AS a, '{b}' AS b, '{','.join(z)}' AS given, {k} AS size, abs(atanh(least(greatest({rho}, -0.999999999999), 0.999999999999))) * sqrt(n - {k + 3}) < {critical} AS independent FROM m")
    r = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in combinations(names, 2))
    return f"m AS MATERIALIZED (SELECT count(*) AS n, {r} FROM l), i AS MATERIALIZED ({' UNION ALL '.join(rows)})"


def _minor(rows: tuple, cols: tuple) -> str:
    """Determinant of the correlations of some rows with some columns."""
    terms = []
    entry = lambda a, b: "1.0::DOUBLE" if a == b else f"r_{min(a, b)}_{max(a, b)}"
    for order in permutations(range(len(cols))):
        odd = sum(order[i] > order[j] for i, j in combinations(range(len(cols)), 2)) % 2
        terms.append(("-" if odd else "+") + "*".join(entry(rows[i], cols[k]) for i, k in enumerate(order)))
    return "".join(terms)


#: Two-sided normal bound of 1e-6 and of 1e-5.
BOUND_6, BOUND_5 = 4.891638475698991, 4.417173413468764

# Three variables: an edge goes where the pair is independent, or independent given the third while the third is next to one of them.
_PC = """f AS (SELECT a, b FROM i WHERE size = 0 AND NOT independent),
s AS (SELECT x.a, x.b FROM f x JOIN i ON i.a = x.a AND i.b = x.b AND i.size = 1 AND i.independent
  WHERE EXISTS (SELECT 1 FROM f y WHERE (y.a, y.b) <> (x.a, x.b) AND i.given IN (y.a, y.b))),
k AS (SELECT a, b FROM f EXCEPT SELECT a, b FROM s),
v AS (SELECT i.given AS c FROM i WHERE size = 1 AND EXISTS (SELECT 1 FROM i o WHERE o.size = 0 AND o.independent AND o.a = i.a AND o.b = i.b)
  AND (SELECT count(*) FROM k WHERE i.given IN (k.a, k.b)) = 2 AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = i.a AND k.b = i.b))
SELECT CASE WHEN a IN (SELECT c FROM v) THEN b ELSE a END AS a, CASE WHEN a IN (SELECT c FROM v) THEN a ELSE b END AS b, a IN (SELECT c FROM v) OR b IN (SELECT c FROM v) AS directed FROM k"""


@query(f"WITH {LINES}, {tests_sql(['e', 'q', 'u'], BOUND_6)}, {_PC}")
def pc_graph(spark, sf_dir):
    """Quantity and price are drawn apart; the price of a unit depends on both."""
    return discovery.pc(spark, lines(spark, sf_dir), ["q", "e", "u"], alpha=1e-6)


@query(f"WITH {PAID}, {tests_sql(['q', 'u', 'w'], BOUND_6)}, {_PC}")
def pc_graph_chain(spark, sf_dir):
    """Quantity, price of a unit and its sum with the discount: a chain, whose direction no test tells."""
    return discovery.pc(spark, paid(spark, sf_dir), ["q", "u", "w"], alpha=1e-6)


# Edges: no set separates the pair. An end at c gets an arrowhead where two strangers next to c were separated without it; a link from c to a stranger
# of one that points at c, separated by a set with c, is an arrow.
_FCI = """n AS (SELECT a, b, bool_or(independent) AS cut, first(given ORDER BY size, given) FILTER (independent) AS given FROM i GROUP BY a, b),
k AS (SELECT a AS x, b AS y FROM n WHERE NOT cut UNION ALL SELECT b, a FROM n WHERE NOT cut),
c AS (SELECT a AS x, b AS y, string_split(given, ',') AS given FROM n WHERE cut UNION ALL SELECT b, a, string_split(given, ',') FROM n WHERE cut),
h AS (SELECT DISTINCT p.x AS x, p.y AS c FROM k p JOIN k q ON q.y = p.y AND q.x <> p.x JOIN c ON c.x = p.x AND c.y = q.x WHERE NOT list_contains(c.given, p.y)),
o AS (SELECT DISTINCT p.y AS c, q.x AS z FROM h JOIN k p ON p.x = h.x AND p.y = h.c JOIN k q ON q.y = p.y AND q.x <> p.x JOIN c ON c.x = p.x AND c.y = q.x WHERE list_contains(c.given, p.y)),
r AS (SELECT x AS a, y AS b, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.x = k.y AND h.c = k.x) OR EXISTS (SELECT 1 FROM o WHERE o.c = k.y AND o.z = k.x) THEN '<' WHEN EXISTS (SELECT 1 FROM o WHERE o.c = k.x AND o.z = k.y) THEN '-' ELSE 'o' END AS l,
  CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.x = k.x AND h.c = k.y) OR EXISTS (SELECT 1 FROM o WHERE o.c = k.x AND o.z = k.y) THEN '>' WHEN EXISTS (SELECT 1 FROM o WHERE o.c = k.y AND o.z = k.x) THEN '-' ELSE 'o' END AS r FROM k WHERE x < y)
SELECT a, b, l || '-' || r AS edge FROM r"""


@query(f"WITH {PAID}, {tests_sql(['e', 'q', 'u', 'w'], BOUND_5)}, {_FCI}")
def fci_graph(spark, sf_dir):
    """Quantity and price act on the price of a unit, and that on the sum: the last arrow has no hidden cause, the others may have."""
    return latent.fci(spark, paid(spark, sf_dir), ["q", "e", "u", "w"], alpha=1e-5)

