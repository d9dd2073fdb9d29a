"""Structural models fitted to lines, counterfactuals from the lines' own residuals, refutations. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from infocausal.operators import refute, scm
from infocausal.operators.features import moments_sql, sweep_sql
from infocausal.plans.catalogue import LI, T_SQL, query, r6, rounded, table, treated

#: t: quantity, m: log price of a unit, y: price in thousands.
LINES = "l AS (SELECT l_orderkey, l_linenumber, l_quantity AS t, ln(l_extendedprice / l_quantity) AS m, l_extendedprice / 1000 AS y FROM lineitem WHERE l_quantity > 0)"
FITTED = f"""{LINES}, {moments_sql('g', 'l', ['t', 'm', 'y'], (), 0.0)}, {sweep_sql('g', [0, 1])},
k AS (SELECT (SELECT v FROM g_1 WHERE i = 0 AND j = 1) AS a, (SELECT v FROM g_2 WHERE i = 0 AND j = 2) AS d, (SELECT v FROM g_2 WHERE i = 1 AND j = 2) AS b)"""


def lines(spark, sf_dir):
    li = table(spark, sf_dir, LI).filter("l_quantity > 0")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("t"), F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("m"), (F.col("l_extendedprice") / 1000).alias("y"))


def model(d) -> scm.Model:
    return scm.fitted(d, {"t": [], "m": ["t"], "y": ["t", "m"]})


@query(f"WITH {FITTED} SELECT {r6('10 * (d + a * b) AS total', '10 * d AS direct')} FROM k")
def scm_do_effects(spark, sf_dir):
    """Of ten more pieces on the price, and the direct effect with the log price of a unit held at its value under ten pieces."""
    d = lines(spark, sf_dir)
    f = model(d)
    d = f.abduct(d)
    d = f.do(t=10.0).simulate(d.drop("t", "m", "y"), "_0")
    d = f.do(t=20.0).simulate(d, "_1")
    d = f.do(t=20.0, m=F.col("m_0")).simulate(d, "_d")
    return rounded(d.agg((F.avg("y_1") - F.avg("y_0")).alias("total"), (F.avg("y_d") - F.avg("y_0")).alias("direct")))


@query(f"WITH {FITTED} SELECT l_orderkey, l_linenumber, {r6('y', 'y + (d + a * b) * (25 - t) AS y_cf')} FROM l, k")
def counterfactual_outcome(spark, sf_dir):
    """Noise is abducted from each line's quantity and prices, then the quantity is set to 25."""
    d = lines(spark, sf_dir)
    return rounded(model(d).counterfactual(d, t=25.0).select("l_orderkey", "l_linenumber", "y", "y_cf"))


@query(f"""WITH {FITTED}, p AS (SELECT y + (d + a * b) * (40 - t) > 52 AS a, y + (d + a * b) * (5 - t) > 50 AS b FROM l, k)
SELECT {r6('avg((a AND b)::INT) AS always', 'avg((NOT a AND NOT b)::INT) AS never', 'avg((a AND NOT b)::INT) AS helped', 'avg((NOT a AND b)::INT) AS hurt')} FROM p""")
def unit_types(spark, sf_dir):
    d = lines(spark, sf_dir)
    f = model(d)
    d = f.abduct(d).drop("t", "m", "y")
    d = f.do(t=40.0).simulate(f.do(t=5.0).simulate(d, "_0"), "_1")
    return rounded(scm.unit_bounds(d.select((F.col("y_1") > 52).alias("a"), (F.col("y_0") > 50).alias("b")), "a", "b"))


WORLDS = {"as it was": {}, "ten": {"t": 10.0}, "forty": {"t": 40.0}, "forty at one price": {"t": 40.0, "m": 7.0}}
_W = {"as it was": "y", "ten": "y + (d + a * b) * (10 - t)", "forty": "y + (d + a * b) * (40 - t)", "forty at one price": "y + d * (40 - t) + b * (7 - m)"}


def _worlds_sql(where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS world, y, {e} AS v FROM l, k WHERE {where}" for n, e in _W.items())


_STATS = f"count(*) AS n, {r6('avg(v) AS mean', 'stddev_samp(v) AS sd', 'quantile_cont(v, 0.05) AS low', 'quantile_cont(v, 0.5) AS middle', 'quantile_cont(v, 0.95) AS high', 'avg(v - y) AS change')}"


@query(f"WITH {FITTED}, w AS ({_worlds_sql('t <= 10')}) SELECT world, {_STATS} FROM w GROUP BY world")
def conditional_worlds(spark, sf_dir):
    """Prices of the lines of ten pieces or fewer, had they been of ten, of forty, and of forty at one price; the change under forty is the effect on those lines."""
    d = lines(spark, sf_dir)
    return rounded(scm.worlds(model(d), d, "y", WORLDS, F.col("t") <= 10).drop("better"))


_C = lambda salt: f"('0x' || substr(md5(k || '|{salt}'), 1, 8))::BIGINT / 4294967296.0"
_REFUTE = {"none": ("z", "t", "true"), "placebo": ("z", "pt", "true"), "random cause": ("concat_ws('|', z, pz)", "t", "true"), "part": ("z", "t", "part")}


@query(f"""WITH {T_SQL}, x AS (SELECT z, t, y, concat_ws('|', ok, ln, q) AS k, avg(t) OVER () AS p FROM d),
c AS (SELECT z, t, y, ({_C('placebo')} < p)::INT AS pt, ({_C('cause')} < 0.5)::INT AS pz, {_C('part')} < 0.8 AS part FROM x),
r AS ({' UNION ALL '.join(f"SELECT '{n}' AS test, {z} AS z, {t} AS t, y FROM c WHERE {keep}" for n, (z, t, keep) in _REFUTE.items())}),
s AS (SELECT test, z, count(*) AS n, avg(y) FILTER (t = 1) AS y1, avg(y) FILTER (t = 0) AS y0 FROM r GROUP BY 1, 2),
g AS (SELECT test, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS naive FROM r GROUP BY 1)
SELECT test, {r6('naive', 'sum(n * (y1 - y0)) / sum(n) AS stratified')} FROM s JOIN g USING (test) WHERE y1 IS NOT NULL AND y0 IS NOT NULL GROUP BY test, naive""")
def refutations(spark, sf_dir):
    return rounded(refute.refutations(treated(spark, sf_dir), ["ok", "ln", "q"]))


@query("""WITH d AS (SELECT (l_tax >= 0.04)::INT AS z, (l_discount + l_tax >= 0.09)::INT AS t, l_extendedprice AS y FROM lineitem),
s AS (SELECT count(*) AS n, avg(y) FILTER (z = 1) - avg(y) FILTER (z = 0) AS intention, avg(y) FILTER (z = 1 AND t = 1) - avg(y) FILTER (z = 0 AND t = 0) AS per_protocol,
  avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS as_treated, avg(t) FILTER (z = 1) - avg(t) FILTER (z = 0) AS uptake, count(*) FILTER (z = 0 AND t = 1) = 0 AS one_sided FROM d)
SELECT n, """ + r6("intention", "per_protocol", "as_treated", "uptake", "intention / uptake AS compliers") + ", one_sided FROM s")
def compliance(spark, sf_dir):
    """A high tax as assignment; a high sum of tax and discount as what was taken."""
    d = table(spark, sf_dir, LI).select((F.col("l_tax") >= 0.04).cast("int").alias("z"), (F.col("l_discount") + F.col("l_tax") >= 0.09).cast("int").alias("t"), F.col("l_extendedprice").alias("y"))
    return rounded(refute.compliance(d, "z", "t", "y"))
