"""Treatments in steps: a customer's months with orders. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from infocausal.operators import longitudinal
from infocausal.operators.features import moments_sql, sweep_sql
from infocausal.plans.catalogue import LI, query, r6, rounded, table

#: A month of a customer: l (an urgent or high order), a (spent over 150,000), spent.
MONTHS_SQL = """mo AS (SELECT o_custkey AS c, date_trunc('month', o_orderdate) AS t, max((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT) AS l,
  (sum(o_totalprice) > 150000)::INT AS a, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t) AS k FROM mo)"""
UNITS = MONTHS_SQL + """,
u AS (SELECT c, max(l) FILTER (k = 1) AS l1, max(a) FILTER (k = 1) AS a1, max(l) FILTER (k = 2) AS l2, max(a) FILTER (k = 2) AS a2, max(y) FILTER (k = 3) AS y FROM k WHERE k <= 3 GROUP BY c HAVING count(*) = 3)"""


def months(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_custkey").alias("c"), F.date_trunc("month", "o_orderdate").alias("t"))
    return m.agg(F.max(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")).alias("l"), (F.sum("o_totalprice") > 150000).cast("int").alias("a"), F.sum("o_totalprice").alias("y"))


def two_steps(spark, sf_dir):
    return longitudinal.units(months(spark, sf_dir), "c", ["t"], {"l": "l", "a": "a"}, 2, "y")


PLANS = [(1, 1), (0, 0), (1, 0)]


def _plan_sql(p: tuple[int, int]) -> str:
    a1, a2 = p
    return f"""SELECT '{a1}{a2}' AS plan, sum(w * c * q) / nullif(sum(w * c), 0) AS mean, sum(w * c) / sum(w) AS covered, sum(f) AS followers FROM (
  SELECT l1, any_value(w) AS w, sum(n * (f > 0)::INT * q) / nullif(sum(n * (f > 0)::INT), 0) AS q, sum(n * (f > 0)::INT) / sum(n) AS c, sum(f)::BIGINT AS f FROM (
    SELECT o.l1, o.w, x.l2, x.n, coalesce(x.f, 0) AS f, coalesce(x.q, 0) AS q FROM (SELECT l1, count(*) AS w FROM u GROUP BY l1) o
    LEFT JOIN (SELECT l1, l2, count(*) AS n, count(*) FILTER (a2 = {a2}) AS f, avg(y) FILTER (a2 = {a2}) AS q FROM u WHERE a1 = {a1} GROUP BY l1, l2) x USING (l1)) GROUP BY l1)"""


@query(f"WITH {UNITS} " + " UNION ALL ".join(f"SELECT plan, {r6('mean', 'covered')}, followers::BIGINT AS followers FROM ({_plan_sql(p)})" for p in PLANS))
def plan_means(spark, sf_dir):
    """Spending in the third month had each customer spent much, or little, in the first two."""
    u, out = two_steps(spark, sf_dir), None
    for p in PLANS:
        r = longitudinal.plan_mean(u, p).select(F.lit("".join(map(str, p))).alias("plan"), "mean", "covered", "followers")
        out = r if out is None else out.unionByName(r)
    return rounded(out)


@query(f"""WITH {UNITS}, w AS (SELECT *, count(*) OVER (PARTITION BY l1) / count(*) OVER (PARTITION BY l1, a1) * count(*) OVER (PARTITION BY l1, a1, l2) / count(*) OVER (PARTITION BY l1, a1, l2, a2) AS w FROM u)
SELECT a1 || '' || a2 AS plan, {r6('sum(w * y) / sum(w) AS mean', 'sum(w) ** 2 / sum(w * w) AS effective_n')}, count(*) AS followers FROM w WHERE (a1, a2) IN ((1, 1), (0, 0), (1, 0)) GROUP BY 1""")
def plan_means_weighted(spark, sf_dir):
    u, out = two_steps(spark, sf_dir), None
    for p in PLANS:
        r = longitudinal.plan_weighted(u, p).select(F.lit("".join(map(str, p))).alias("plan"), "mean", "effective_n", "followers")
        out = r if out is None else out.unionByName(r)
    return rounded(out)


_G = ["a", "d", "q", "u", "e"]


@query(f"""WITH l AS (SELECT (l_discount >= 0.05)::INT::DOUBLE AS a, l_tax AS d, l_quantity AS q, ln(l_extendedprice / l_quantity) AS u, l_extendedprice AS e FROM lineitem WHERE l_quantity > 0),
{moments_sql('g', 'l', _G, (), 0.0)}, {sweep_sql('g', range(4))},
b AS (SELECT v AS b FROM g_4 WHERE i = 3 AND j = 4),
y AS (SELECT a, d, e - b * u AS y, e FROM l, b),
{moments_sql('h', 'y', ['a', 'd', 'y', 'e'], (), 0.0)}, {sweep_sql('h', range(2))}
SELECT (SELECT count(*) FROM l) AS n, {r6('(SELECT b FROM b) AS mediator_effect', '(SELECT v FROM h_2 WHERE i = 0 AND j = 2) AS direct', '(SELECT v FROM h_2 WHERE i = 0 AND j = 3) AS total')}""")
def sequential_g(spark, sf_dir):
    """Discount on price, with the log price of a unit held; the quantity comes between and acts on both."""
    li = table(spark, sf_dir, LI).filter("l_quantity > 0")
    d = li.select((F.col("l_discount") >= 0.05).cast("int").alias("a"), F.col("l_tax").alias("d"), F.col("l_quantity").alias("q"), F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"), F.col("l_extendedprice").alias("e"))
    return rounded(longitudinal.sequential_g(spark, d, "a", "u", "e", ["q"], ["d"]))


_M = ["a1", "m1", "m2", "y"]


@query(f"""WITH {MONTHS_SQL}, u AS (SELECT c, max(a) FILTER (k = 1)::DOUBLE AS a1, max(y) FILTER (k = 2) / 1000 AS m1, max(y) FILTER (k = 3) / 1000 AS m2, max(y) FILTER (k = 4) / 1000 AS y FROM k WHERE k <= 4 GROUP BY c HAVING count(*) = 4),
{moments_sql('g', 'u', _M, (), 0.0)}, {sweep_sql('g', range(3))}
SELECT 1 AS step, {r6('d.v AS direct', 'a.v * b.v AS indirect', 'd.v + a.v * b.v AS total')} FROM g_2 d, g_1 a, g_2 b WHERE (d.i, d.j) = (0, 3) AND (a.i, a.j) = (0, 1) AND (b.i, b.j) = (1, 3)
UNION ALL SELECT 2, {r6('d.v AS direct', 'a.v * b.v + p.v * q.v AS indirect', 'd.v + a.v * b.v + p.v * q.v AS total')} FROM g_3 d, g_1 a, g_3 b, g_1 p, g_3 q
WHERE (d.i, d.j) = (0, 3) AND (a.i, a.j) = (0, 1) AND (b.i, b.j) = (1, 3) AND (p.i, p.j) = (0, 2) AND (q.i, q.j) = (2, 3)""")
def longitudinal_mediation(spark, sf_dir):
    """A first month of much spending, on the fourth month's, through the second's and third's (in thousands)."""
    u = longitudinal.units(months(spark, sf_dir), "c", ["t"], {"a": "a", "m": "y"}, 3, "y")
    d = u.select("a1", *[(F.col(c) / 1000).alias(n) for c, n in (("m2", "m1"), ("m3", "m2"), ("y", "y"))])
    return rounded(longitudinal.longitudinal_mediation(spark, d, "a1", ["m1", "m2"], "y"))
