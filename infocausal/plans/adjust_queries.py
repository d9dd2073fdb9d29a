"""Adjustment sets over columns of lineitem, and motifs of a graph that grows. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.operators import adjust, census, genetic
from infocausal.operators.features import moments_sql, sweep_sql
from infocausal.plans.catalogue import LI, query, r6, rounded, table

#: t: discount of 5 % or more; q: quantity; tax; u: log price of a unit; e: price in thousands.
EDGES = [("q", "t"), ("q", "u"), ("tax", "u"), ("t", "e"), ("u", "e")]
COLUMNS = ["t", "e", "q", "tax", "u"]
SETS = [("q",), ("u",), ("q", "tax"), ("q", "u"), ("tax", "u"), ("q", "tax", "u")]


def _set_sql(i: int, z: tuple[str, ...]) -> str:
    cols = ["t", *z, "e"]
    k = len(cols) - 1
    return f"""{moments_sql(f'a{i}', 'l', cols, (), 0.0)}, {sweep_sql(f'a{i}', range(k))}, {moments_sql(f'b{i}', 'l', [*z, 't'], (), 0.0)}, {sweep_sql(f'b{i}', range(len(z)))}"""


def _row_sql(i: int, z: tuple[str, ...]) -> str:
    k = len(z) + 1
    return f"""SELECT '{','.join(z)}' AS adjusted, {r6(f'(SELECT v FROM a{i}_{k} WHERE i = 0 AND j = {k}) AS estimate', f'sqrt((SELECT v FROM a{i}_{k} WHERE i = {k} AND j = {k}) / (SELECT v FROM b{i}_{len(z)} WHERE i = {len(z)} AND j = {len(z)}) / (SELECT count(*) FROM l)) AS se')}, {str(set(z) == {'u'}).lower()} AS optimal"""


@query("WITH l AS (SELECT (l_discount >= 0.05)::INT::DOUBLE AS t, l_extendedprice / 1000 AS e, l_quantity AS q, l_tax AS tax, ln(l_extendedprice / l_quantity) AS u FROM lineitem WHERE l_quantity > 0), "
       + ", ".join(_set_sql(i, z) for i, z in enumerate(SETS)) + " " + " UNION ALL ".join(_row_sql(i, z) for i, z in enumerate(SETS)))
def adjusted_effects(spark, sf_dir):
    """All valid sets of q -> t, q -> u <- tax, t -> e <- u; u alone is the one with the least asymptotic variance."""
    li = table(spark, sf_dir, LI).filter("l_quantity > 0")
    d = li.select((F.col("l_discount") >= 0.05).cast("int").alias("t"), (F.col("l_extendedprice") / 1000).alias("e"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax"), F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return rounded(adjust.adjusted_effects(spark, d, EDGES, "t", "e"))


#: A part points to the part of the next line of its order.
NEXT = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""


def next_parts(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf_dir, LI).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.filter("dst is not null and src != dst").distinct()


# A pair's code from its smaller node: 1 out, 2 in, 3 both. A triple x < y < z has the codes xy, yz, xz.
_DYADS = "p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(DISTINCT CASE WHEN src < dst THEN 1 ELSE 2 END)::INT AS d FROM {e} GROUP BY {by}1, 2)"
_KIND = """CASE WHEN m = 3 THEN '300' WHEN m = 2 THEN '210'
  WHEN xy = 3 THEN CASE WHEN xz = 2 AND yz = 2 THEN '120D' WHEN xz = 1 AND yz = 1 THEN '120U' ELSE '120C' END
  WHEN yz = 3 THEN CASE WHEN xy = 1 AND xz = 1 THEN '120D' WHEN xy = 2 AND xz = 2 THEN '120U' ELSE '120C' END
  WHEN xz = 3 THEN CASE WHEN xy = 2 AND yz = 1 THEN '120D' WHEN xy = 1 AND yz = 2 THEN '120U' ELSE '120C' END
  WHEN (xy, yz, xz) IN ((1, 1, 2), (2, 2, 1)) THEN '030C' ELSE '030T' END"""
_TRIANGLES = "SELECT {by}xy, yz, xz, (xy = 3)::INT + (yz = 3)::INT + (xz = 3)::INT AS m FROM (SELECT {pby}p.d AS xy, q.d AS yz, r.d AS xz FROM p JOIN p q ON q.a = p.b{qon} JOIN p r ON r.a = p.a AND r.b = q.b{ron})"


@query(f"""WITH {NEXT}, {_DYADS.format(e='e', by='')}, n AS (SELECT count(*) AS n FROM (SELECT a FROM p UNION SELECT b FROM p)),
t AS MATERIALIZED ({_TRIANGLES.format(by='', pby='', qon='', ron='')}), c AS (SELECT {_KIND} AS kind, count(*) AS n FROM t GROUP BY 1),
l AS (SELECT a AS v, b AS o, d FROM p UNION ALL SELECT b, a, CASE WHEN d = 3 THEN 3 ELSE 3 - d END FROM p),
w AS (SELECT least(x.d, y.d) AS s, greatest(x.d, y.d) AS g FROM l x JOIN l y ON x.v = y.v AND x.o < y.o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = x.o AND p.b = y.o)),
o AS (SELECT CASE (s, g) WHEN (1, 1) THEN '021D' WHEN (2, 2) THEN '021U' WHEN (1, 2) THEN '021C' WHEN (2, 3) THEN '111D' WHEN (1, 3) THEN '111U' ELSE '201' END AS kind, count(*) AS n FROM w GROUP BY 1),
u AS (SELECT CASE WHEN p.d = 3 THEN '102' ELSE '012' END AS kind, sum(n.n - (SELECT count(DISTINCT o) FROM l WHERE v = p.a OR v = p.b)) AS n FROM p, n GROUP BY 1),
f AS (SELECT * FROM c UNION ALL SELECT * FROM o UNION ALL SELECT * FROM u),
k(kind) AS (VALUES {', '.join(f"('{k}')" for k in ('012', '102', '021D', '021U', '021C', '111D', '111U', '030T', '030C', '201', '120D', '120U', '120C', '210', '300'))})
SELECT kind, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN f USING (kind) UNION ALL SELECT '003', (n.n::BIGINT * (n.n - 1) * (n.n - 2) // 6 - (SELECT sum(n) FROM f))::BIGINT FROM n""")
def triad_census(spark, sf_dir):
    """All sixteen classes, over the parts that follow each other in orders."""
    return census.triad_census(next_parts(spark, sf_dir))


REPLICATES, ROUNDS = 3, 3


def _swap_sql(i: int) -> str:
    u = lambda tag: f"('0x' || substr(md5(concat_ws('|', 1, {i}, rep, src, dst, '{tag}')), 1, 8))::BIGINT / 4294967296.0"
    return f"""h{i} AS MATERIALIZED (SELECT rep, src, dst, floor({u('box')} * k)::BIGINT AS box, {u('order')} AS u FROM g{i}, boxes),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY rep, box ORDER BY u, src, dst) AS k FROM h{i}),
s{i} AS MATERIALIZED (SELECT a.rep, a.box, a.src AS s1, a.dst AS d1, b.src AS s2, b.dst AS d2 FROM r{i} a JOIN r{i} b ON a.rep = b.rep AND a.box = b.box AND a.k = 1 AND b.k = 2
  WHERE a.src <> b.dst AND b.src <> a.dst AND a.src <> b.src AND a.dst <> b.dst),
m{i} AS MATERIALIZED (SELECT rep, box, s1 AS src, d2 AS dst FROM s{i} UNION ALL SELECT rep, box, s2, d1 FROM s{i}),
x{i} AS (SELECT rep, box FROM m{i} JOIN g{i} USING (rep, src, dst) UNION SELECT rep, box FROM m{i} JOIN (SELECT rep, src, dst FROM m{i} GROUP BY ALL HAVING count(*) > 1) USING (rep, src, dst)),
y{i} AS MATERIALIZED (SELECT * FROM s{i} ANTI JOIN x{i} USING (rep, box)),
g{i + 1} AS MATERIALIZED (SELECT * FROM g{i} ANTI JOIN (SELECT rep, s1 AS src, d1 AS dst FROM y{i} UNION ALL SELECT rep, s2, d2 FROM y{i}) USING (rep, src, dst) UNION ALL SELECT rep, s1, d2 FROM y{i} UNION ALL SELECT rep, s2, d1 FROM y{i})"""


@query(f"""WITH {NEXT}, boxes AS (SELECT greatest(count(*) // 3, 1) AS k FROM e), g0 AS MATERIALIZED (SELECT rep::INT AS rep, src, dst FROM e, range(0, {REPLICATES}) AS q(rep)), {', '.join(_swap_sql(i) for i in range(ROUNDS))},
w AS (SELECT -1 AS rep, src, dst FROM e UNION ALL SELECT * FROM g{ROUNDS}),
p AS MATERIALIZED (SELECT rep, least(src, dst) AS a, greatest(src, dst) AS b, sum(DISTINCT CASE WHEN src < dst THEN 1 ELSE 2 END)::INT AS d FROM w GROUP BY 1, 2, 3),
t AS ({_TRIANGLES.format(by='rep, ', pby='p.rep, ', qon=' AND q.rep = p.rep', ron=' AND r.rep = p.rep')}), c AS (SELECT rep, {_KIND} AS kind, count(*) AS n FROM t GROUP BY 1, 2),
z AS (SELECT kind, coalesce(sum(n) FILTER (rep < 0), 0)::BIGINT AS n, coalesce(sum(n) FILTER (rep >= 0), 0) AS s1, coalesce(sum(n * n) FILTER (rep >= 0), 0) AS s2 FROM c GROUP BY 1),
v AS (SELECT kind, n, s1 / {REPLICATES} AS mean, sqrt(greatest((s2 - s1 * s1 / {REPLICATES}) / {REPLICATES - 1}, 0)) AS sd FROM z)
SELECT kind, n, {r6('mean', 'sd', '(n - mean) / nullif(sd, 0) AS z')} FROM v""")
def motif_scores(spark, sf_dir):
    return rounded(census.motif_scores(next_parts(spark, sf_dir), REPLICATES, ROUNDS))


WEIGHTS, CALIPER = [(1.0, 1.0), (3.0, 0.5), (0.25, 2.0)], 0.05


@query(f"""WITH o AS (SELECT o_orderkey AS k, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS t, (o_orderstatus = 'F')::INT::DOUBLE AS y, ln(o_totalprice) AS a, epoch(o_orderdate) / 86400 AS b FROM orders),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, covar_pop(a, b) / stddev_pop(a) / stddev_pop(b) AS r FROM o),
z AS (SELECT k, t, y, a, b, (a - ma) / sa AS w0, ((b - mb) / sb - r * (a - ma) / sa) / sqrt(1 - r * r) AS w1 FROM o, m),
c(candidate, s0, s1) AS (VALUES {', '.join(f'({i}, sqrt({u}::DOUBLE), sqrt({v}::DOUBLE))' for i, (u, v) in enumerate(WEIGHTS))}),
x AS MATERIALIZED (SELECT candidate, k, t, y, a, b, w0 * s0 AS z0, w1 * s1 AS z1, floor(w0 * s0 / {CALIPER})::BIGINT AS c0, floor(w1 * s1 / {CALIPER})::BIGINT AS c1 FROM z, c),
n AS (SELECT candidate, k, y, a, b, z0, z1, c0 + d0 AS c0, c1 + d1 AS c1 FROM x, (VALUES (-1), (0), (1)) AS p(d0), (VALUES (-1), (0), (1)) AS q(d1) WHERE t = 0),
p AS (SELECT x.candidate, x.k, n.k AS match, x.y, n.y AS y2, x.a, n.a AS a2, x.b, n.b AS b2, sqrt((x.z0 - n.z0) * (x.z0 - n.z0) + (x.z1 - n.z1) * (x.z1 - n.z1)) AS d FROM x JOIN n USING (candidate, c0, c1) WHERE x.t = 1),
f AS (SELECT * FROM p WHERE d <= {CALIPER} QUALIFY row_number() OVER (PARTITION BY candidate, k ORDER BY round(d, 12), match) = 1),
s AS (SELECT count(*) AS n, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM o WHERE t = 1)
SELECT candidate, count(*) AS n, {r6('count(*) / any_value(s.n) AS share', 'avg(y - y2) AS att', 'greatest(abs(avg(a - a2)) / any_value(sa), abs(avg(b - b2)) / any_value(sb)) AS imbalance')} FROM f, s GROUP BY candidate""")
def mahalanobis_matches(spark, sf_dir):
    """Urgent orders with others of like price and date, on three weighted metrics; is the order finished?"""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"), (F.col("o_orderstatus") == "F").cast("double").alias("y"),
        F.log("o_totalprice").alias("a"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6).alias("b"))
    return rounded(genetic.match_scores(o, ["a", "b"], "k", WEIGHTS, CALIPER))
