"""Named queries over the fixed tables, each with SQL that gives the same rows in DuckDB.

Results are rounded to six places on both sides. Queries without SQL are iterative or numeric
(network ranks, searches, kernels); their tests hold them against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.operators import components, dependence, effects, graph, information, kernels, series
from infocausal.scratch import tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def r6(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


# ---------------------------------------------------------------- series of events

HOURLY = "s AS (SELECT event_type AS series, floor(epoch(ts) / 3600)::BIGINT AS t, sum(value) AS v FROM events GROUP BY 1, 2)"
DAILY = "s AS (SELECT event_type AS series, floor(epoch(ts) / 86400)::BIGINT AS t, sum(value) AS v FROM events GROUP BY 1, 2)"


def summed(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1e6)).cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), t.alias("t")).agg(F.sum("value").alias("v"))


def binned_sql(bins: int, src: str = "s", by: str = "series") -> str:
    return f"""m AS (SELECT {by}, min(v) AS lo, max(v) AS hi FROM {src} GROUP BY {by}),
b AS (SELECT {src}.*, least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * {bins}), 0), {bins} - 1)::INT AS b FROM {src} JOIN m USING ({by}))"""


EMBED = """e AS (SELECT * FROM (SELECT series, t, b AS past, lead(b) OVER (PARTITION BY series ORDER BY t) AS future,
  lead(t) OVER (PARTITION BY series ORDER BY t) AS t2 FROM b) WHERE t2 = t + 1)"""


def te_sql(pairs: str, by: str, xf: str = "xf", yp: str = "yp", z: str = "xp", out: str = "te") -> str:
    return f"""c AS (SELECT {by}, {xf}, {yp}, {z}, count(*) AS n FROM {pairs} GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY {by}) AS nn, sum(n) OVER (PARTITION BY {by}, {z}) AS nz,
  sum(n) OVER (PARTITION BY {by}, {xf}, {z}) AS nxz, sum(n) OVER (PARTITION BY {by}, {yp}, {z}) AS nyz FROM c),
te AS (SELECT {by}, sum(n)::BIGINT AS n_obs, greatest(sum(n / nn * ln(n * nz / (nxz * nyz))), 0) AS {out} FROM k GROUP BY {by})"""


PAIRS = """p AS (SELECT x.series AS target, y.series AS source, x.future AS xf, x.past AS xp, y.past AS yp
  FROM e x JOIN e y USING (t) WHERE x.series <> y.series)"""
TE_HOURLY = f"{HOURLY}, {binned_sql(8)}, {EMBED}, {PAIRS}, {te_sql('p', 'target, source')}"


def _te(spark: SparkSession, sf_dir: str, bins: int = 8) -> DataFrame:
    b = information.equal_width_bins(summed(spark, sf_dir), "v", bins, ["series"])
    return information.transfer_entropy_pairs(information.embedded(b, "series", "t", "b"), "series", "t")


@query(f"WITH {TE_HOURLY} SELECT target, source, n_obs, {r6('te')} FROM te")
def te_pairs_hourly(spark, sf_dir):
    return rounded(_te(spark, sf_dir))


@query(f"""WITH {TE_HOURLY} SELECT a.source AS x, a.target AS y, {r6('(a.te - b.te) / nullif(a.te + b.te, 0) AS direction')}
FROM te a JOIN te b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target""")
def te_directionality(spark, sf_dir):
    te = _te(spark, sf_dir)
    back = te.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("te").alias("back"))
    d = (F.col("te") - F.col("back")) / F.nullif(F.col("te") + F.col("back"), F.lit(0.0))
    return rounded(te.join(back, ["source", "target"]).filter("source < target").select(F.col("source").alias("x"), F.col("target").alias("y"), d.alias("direction")))


@query(f"""WITH {HOURLY}, g AS (SELECT scale, series, t // scale AS t, avg(v) AS v FROM s, (VALUES (1), (2), (3), (4)) AS k(scale) GROUP BY 1, 2, 3),
{binned_sql(6, 'g', 'scale, series')},
e AS (SELECT * FROM (SELECT scale, series, t, b AS past, lead(b) OVER (PARTITION BY scale, series ORDER BY t) AS future,
  lead(t) OVER (PARTITION BY scale, series ORDER BY t) AS t2 FROM b) WHERE t2 = t + 1),
p AS (SELECT x.scale, x.series AS target, y.series AS source, x.future AS xf, x.past AS xp, y.past AS yp FROM e x JOIN e y USING (scale, t) WHERE x.series <> y.series),
{te_sql('p', 'scale, target, source')} SELECT scale, target, source, n_obs, {r6('te')} FROM te""")
def te_multiscale(spark, sf_dir):
    s = summed(spark, sf_dir).withColumn("scale", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    g = s.groupBy("scale", "series", F.expr("t div scale").alias("t")).agg(F.avg("v").alias("v"))
    b = information.equal_width_bins(g, "v", 6, ["scale", "series"])
    return rounded(information.transfer_entropy_pairs(information.embedded(b, "series", "t", "b", ["scale"]), "series", "t", ["scale"]))


@query(f"""WITH {HOURLY}, {binned_sql(4)}, {EMBED},
p AS (SELECT w::BIGINT AS win, x.series AS target, y.series AS source, x.future AS xf, x.past AS xp, y.past AS yp
  FROM e x JOIN e y USING (t), (VALUES (0), (1)) AS o(o), LATERAL (SELECT x.t // 84 - o.o AS w) WHERE x.series <> y.series),
{te_sql('p', 'win, target, source')} SELECT win, target, source, n_obs, {r6('te')} FROM te""")
def te_sliding_window(spark, sf_dir):
    """Windows of 168 hours every 84 hours: each transition belongs to two."""
    b = information.equal_width_bins(summed(spark, sf_dir), "v", 4, ["series"])
    e = information.embedded(b, "series", "t", "b").withColumn("win", F.explode(F.array(F.expr("t div 84"), F.expr("t div 84 - 1"))))
    return rounded(information.transfer_entropy_pairs(e, "series", "t", ["win"]))


@query(f"""WITH {HOURLY}, {binned_sql(4)}, {EMBED},
p AS (SELECT x.series AS target, y.series AS source, z.series AS given, x.future AS xf, x.past AS xp, y.past AS yp, z.past AS zp
  FROM e x JOIN e y USING (t) JOIN e z USING (t) WHERE x.series <> y.series AND x.series <> z.series AND y.series <> z.series),
{te_sql('p', 'target, source, given', z='xp, zp')} SELECT target, source, given, n_obs, {r6('te')} FROM te""")
def te_conditional(spark, sf_dir):
    b = information.equal_width_bins(summed(spark, sf_dir), "v", 4, ["series"])
    e = information.embedded(b, "series", "t", "b")
    x = e.select(F.col("series").alias("target"), "t", F.col("past").alias("xp"), F.col("future").alias("xf"))
    y = e.select(F.col("series").alias("source"), "t", F.col("past").alias("yp"))
    z = e.select(F.col("series").alias("given"), "t", F.col("past").alias("zp"))
    p = x.join(y, "t").join(z, "t").filter("target != source and target != given and source != given")
    return rounded(information.conditional_information(p, "xf", "yp", ["xp", "zp"], ["target", "source", "given"]))


ORDINAL = """o AS (SELECT series, t, v, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)),
b AS (SELECT series, t, v, v1, v2, (((v1 < v)::INT + (v2 < v)::INT) * 9 + ((v <= v1)::INT + (v2 < v1)::INT) * 3 + (v <= v2)::INT + (v1 <= v2)::INT) AS b FROM o WHERE v2 IS NOT NULL)"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("t")
    p = summed(spark, sf_dir).select("series", "t", "v", F.lead("v", 1).over(w).alias("v1"), F.lead("v", 2).over(w).alias("v2"), information.ordinal_pattern("v", 3, w).alias("b"))
    return p.filter("b is not null")


@query(f"WITH {HOURLY}, {ORDINAL}, {EMBED}, {PAIRS}, {te_sql('p', 'target, source')} SELECT target, source, n_obs, {r6('te')} FROM te")
def te_symbolic(spark, sf_dir):
    e = information.embedded(_patterns(spark, sf_dir), "series", "t", "b")
    return rounded(information.transfer_entropy_pairs(e, "series", "t"))


@query(f"""WITH {HOURLY}, {ORDINAL},
c AS (SELECT series, b, count(*) AS n, sum(((v - (v + v1 + v2) / 3) ** 2 + (v1 - (v + v1 + v2) / 3) ** 2 + (v2 - (v + v1 + v2) / 3) ** 2) / 3) AS w FROM b GROUP BY 1, 2),
q AS (SELECT series, n / sum(n) OVER (PARTITION BY series) AS p, w / sum(w) OVER (PARTITION BY series) AS q FROM c)
SELECT series, {r6('-sum(p * ln(p)) AS pe', '-sum(q * ln(q)) AS weighted_pe')} FROM q GROUP BY series""")
def permutation_entropy(spark, sf_dir):
    p = _patterns(spark, sf_dir).withColumn("m", (F.col("v") + F.col("v1") + F.col("v2")) / 3)
    var = sum(((F.col(c) - F.col("m")) * (F.col(c) - F.col("m")) for c in ("v1", "v2")), (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))) / 3
    c = p.groupBy("series", "b").agg(F.count("*").alias("n"), F.sum(var).alias("w"))
    pe = information.entropy_of_counts(c, "n", ["series"]).withColumnRenamed("h", "pe")
    return rounded(pe.join(information.entropy_of_counts(c, "w", ["series"]).withColumnRenamed("h", "weighted_pe"), "series"))


@query(f"""WITH {HOURLY}, {binned_sql(6)}, {EMBED}, f AS (SELECT series, past, future, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY series) AS t, sum(n) OVER (PARTITION BY series, past) AS np, sum(n) OVER (PARTITION BY series, future) AS nf FROM f)
SELECT series, {r6('greatest(sum(n / t * ln(n * t / (np * nf))), 0) AS ais', '-sum(n / t * ln(n / np)) AS entropy_rate')} FROM k GROUP BY series""")
def information_storage(spark, sf_dir):
    """Active information storage I(past; future) and the entropy rate H(future | past)."""
    e = information.embedded(information.equal_width_bins(summed(spark, sf_dir), "v", 6, ["series"]), "series", "t", "b")
    ais = information.mutual_information(e, "past", "future", ["series"]).withColumnRenamed("mi", "ais")
    joint = information.state_entropy(e, ["past", "future"], ["series"]).withColumnRenamed("h", "hj")
    own = information.state_entropy(e, ["past"], ["series"])
    return rounded(ais.join(joint, "series").join(own, "series").select("series", "ais", (F.col("hj") - F.col("h")).alias("entropy_rate")))


@query(f"""WITH {HOURLY}, {binned_sql(4)}, h AS (SELECT series, b * 4 + lead(b, 1) OVER w AS past, lead(b, 2) OVER w * 4 + lead(b, 3) OVER w AS future, t, lead(t, 3) OVER w AS t3
  FROM b WINDOW w AS (PARTITION BY series ORDER BY t)), e AS (SELECT * FROM h WHERE t3 = t + 3), f AS (SELECT series, past, future, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY series) AS t, sum(n) OVER (PARTITION BY series, past) AS np, sum(n) OVER (PARTITION BY series, future) AS nf FROM f)
SELECT series, {r6('greatest(sum(n / t * ln(n * t / (np * nf))), 0) AS mi')} FROM k GROUP BY series""")
def predictive_information(spark, sf_dir):
    """I(two past bins; two future bins)."""
    w = Window.partitionBy("series").orderBy("t")
    b = information.equal_width_bins(summed(spark, sf_dir), "v", 4, ["series"])
    h = b.select("series", "t", (F.col("b") * 4 + F.lead("b", 1).over(w)).alias("past"), (F.lead("b", 2).over(w) * 4 + F.lead("b", 3).over(w)).alias("future"), F.lead("t", 3).over(w).alias("t3"))
    return rounded(information.mutual_information(h.filter("t3 = t + 3"), "past", "future", ["series"]))


LI = "lineitem"


@query("""WITH s AS (SELECT l_returnflag AS series, l_extendedprice AS v FROM lineitem), """ + binned_sql(16) + """,
c AS (SELECT series, b, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT series, n / sum(n) OVER (PARTITION BY series) AS p FROM c)
SELECT series, """ + r6("-sum(p * ln(p)) AS shannon", "-ln(sum(p * p)) AS renyi2", "2 * ln(sum(sqrt(p))) AS renyi_half", "1 - sum(p * p) AS tsallis2", "(1 - sum(sqrt(p))) / -0.5 AS tsallis_half") + " FROM p GROUP BY series")
def entropies(spark, sf_dir):
    s = table(spark, sf_dir, LI).select(F.col("l_returnflag").alias("series"), F.col("l_extendedprice").alias("v"))
    c = information.equal_width_bins(s, "v", 16, ["series"]).groupBy("series", "b").agg(F.count("*").alias("n"))
    p = c.select("series", (F.col("n") / F.sum("n").over(Window.partitionBy("series"))).alias("p"))
    x = F.col("p")
    return rounded(p.groupBy("series").agg(
        information.renyi(x, 1).alias("shannon"), information.renyi(x, 2).alias("renyi2"), information.renyi(x, 0.5).alias("renyi_half"),
        information.tsallis(x, 2).alias("tsallis2"), information.tsallis(x, 0.5).alias("tsallis_half")))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH u AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]) + """) AS q(a, b)),
l AS (SELECT row_number() OVER () AS i, * FROM lineitem), s AS (SELECT i, series, v FROM l UNPIVOT (v FOR series IN (""" + ", ".join(NUMERIC) + "))), " + binned_sql(8) + """,
f AS (SELECT u.a, u.b, x.b AS x, y.b AS y, count(*) AS n FROM u JOIN b x ON x.series = u.a JOIN b y ON y.series = u.b AND y.i = x.i GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny FROM f)
SELECT a, b, """ + r6("greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi") + " FROM k GROUP BY a, b")
def mutual_information_pairs(spark, sf_dir):
    """Rows are binned in place and every row yields its pairs, so nothing is joined back."""
    x = table(spark, sf_dir, LI).select(*NUMERIC)
    for c in NUMERIC:
        x = information.equal_width_bins(x, c, 8, [], out=f"b_{c}")
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"b_{a}").alias("x"), F.col(f"b_{b}").alias("y")) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
    return rounded(information.mutual_information(x.select(F.explode(F.array(*pairs)).alias("r")).select("r.*"), "x", "y", ["a", "b"]))


@query("""WITH c AS (SELECT l.toxic AS t, l.quality AS a, d.lang AS b, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL),
k AS (SELECT *, sum(n) OVER () AS tt, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb,
  sum(n) OVER (PARTITION BY t, a) AS nta, sum(n) OVER (PARTITION BY t, b) AS ntb, sum(n) OVER (PARTITION BY a, b) AS nab FROM c),
p AS (SELECT t, sum(n / tt * ln(nta * tt / (nt * na))) AS ia, sum(n / tt * ln(ntb * tt / (nt * nb))) AS ib, sum(n / tt * ln(n * tt / (nt * nab))) AS iab FROM k GROUP BY t),
w AS (SELECT sum(ia) AS mi_a, sum(ib) AS mi_b, sum(iab) AS mi_ab, sum(least(ia, ib)) AS r FROM p)
SELECT """ + r6("mi_a", "mi_b", "mi_ab", "r AS redundancy", "mi_a - r AS unique_a", "mi_b - r AS unique_b", "mi_ab - mi_a - mi_b + r AS synergy") + " FROM w")
def partial_information(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(information.partial_information(d, "toxic", "quality", "lang"))


def _g2_sql(x: str, y: str, z: str, src: str) -> str:
    zs, over = (f", {z} AS z", "PARTITION BY z") if z else (", 0 AS z", "PARTITION BY z")
    return f"""WITH c AS (SELECT {x} AS x, {y} AS y{zs}, count(*) AS n FROM {src} GROUP BY ALL),
k AS (SELECT *, sum(n) OVER ({over}) AS t, sum(n) OVER ({over}, x) AS nx, sum(n) OVER ({over}, y) AS ny FROM c),
g AS (SELECT z, sum(2 * n * ln(n * t / (nx * ny))) AS g, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS d FROM k WHERE t >= 5 GROUP BY z)
SELECT {r6('sum(g) AS g2')}, sum(d)::BIGINT AS dof FROM g"""


@query(_g2_sql("o_orderstatus", "o_orderpriority", "", "orders"))
def g2_marginal(spark, sf_dir):
    return rounded(dependence.g_squared(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query(_g2_sql("l_returnflag", "l_linestatus", "l_linenumber", "lineitem"))
def g2_conditional(spark, sf_dir):
    return rounded(dependence.g_squared(table(spark, sf_dir, LI), "l_returnflag", "l_linestatus", ["l_linenumber"]))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'coalesce(corr({a}, {b}), 0) AS r')} FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]))
def correlation_matrix(spark, sf_dir):
    return rounded(dependence.correlation_long(table(spark, sf_dir, LI), list(NUMERIC)))


@query("""WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz, count(*) AS n FROM lineitem),
r AS (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM m)
SELECT n, """ + r6("r", "atanh(r) AS fisher_z", "sqrt(n - 4) * atanh(r) AS statistic") + " FROM r")
def partial_correlation(spark, sf_dir):
    return rounded(dependence.partial_correlation(table(spark, sf_dir, LI), "l_quantity", "l_extendedprice", "l_discount"))


OLS = """WITH m AS (SELECT count(*) AS n, avg(l_extendedprice / 1000) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb,
  covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice / 1000) AS ay, covar_pop(l_discount, l_extendedprice / 1000) AS byy, var_pop(l_extendedprice / 1000) AS yy FROM lineitem),
o AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m),
f AS (SELECT n, my - b1 * ma - b2 * mb AS b0, b1, b2, yy - b1 * ay - b2 * byy AS sigma2 FROM o)"""


def _ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.two_regressors(table(spark, sf_dir, LI), F.col("l_extendedprice") / 1000, F.col("l_quantity"), F.col("l_discount"))


@query(OLS + " SELECT n, " + r6("b0", "b1", "b2", "sigma2") + " FROM f")
def ols_two_regressors(spark, sf_dir):
    return rounded(_ols(spark, sf_dir))


@query(OLS + " SELECT " + r6("-n * ln(sigma2) - 3 * ln(n) AS bic", "-n * ln(sigma2) - 6 AS aic") + " FROM f")
def local_scores(spark, sf_dir):
    n, s = F.col("n"), F.col("sigma2")
    return rounded(_ols(spark, sf_dir).select((-n * F.log(s) - 3 * F.log(n)).alias("bic"), (-n * F.log(s) - 6).alias("aic")))


# ---------------------------------------------------------------- effects

T_SQL = """d AS (SELECT (l_discount >= 0.05)::INT AS t, l_extendedprice AS y, (l_returnflag = 'R')::INT::DOUBLE AS yb, l_quantity AS q, l_tax AS tax,
  l_orderkey AS ok, l_linenumber AS ln, l_linestatus AS ls, o_orderpriority AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
STRATA = f"""WITH {T_SQL}, s AS (SELECT z, count(*) AS n, sum(t) AS n1, sum(1 - t) AS n0, avg(y) FILTER (t = 1) AS y1, avg(y) FILTER (t = 0) AS y0 FROM d GROUP BY z),
k AS (SELECT *, n1 / n AS e FROM s WHERE n1 > 0 AND n0 > 0)"""


def treated(spark: SparkSession, sf_dir: str, y: Column | None = None, z: str = "o_orderpriority") -> DataFrame:
    """t: discount of 5 % or more; y: price; z: the order's priority."""
    li = table(spark, sf_dir, LI)
    j = li.join(table(spark, sf_dir, "orders"), li["l_orderkey"] == F.col("o_orderkey"))
    y = F.col("l_extendedprice") if y is None else y
    return j.select((F.col("l_discount") >= 0.05).cast("int").alias("t"), y.alias("y"), F.col(z).alias("z"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax"),
                    F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_linestatus").alias("ls"))


@query(f"""WITH {T_SQL}, s AS (SELECT sum(t)::BIGINT AS n1, sum(1 - t)::BIGINT AS n0, avg(y) FILTER (t = 1) AS a, avg(y) FILTER (t = 0) AS b, var_samp(y) FILTER (t = 1) AS v1, var_samp(y) FILTER (t = 0) AS v0 FROM d)
SELECT n1, n0, {r6('a - b AS ate', 'sqrt(v1 / n1 + v0 / n0) AS se')} FROM s""")
def naive_ate(spark, sf_dir):
    return rounded(effects.naive(treated(spark, sf_dir)))


@query(f"WITH {T_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, {r6(f'(avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0)) / sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2) AS smd')} FROM d" for c in ("q", "tax")))
def smd_balance(spark, sf_dir):
    return rounded(effects.balance(treated(spark, sf_dir), ["q", "tax"]))


@query(STRATA + " SELECT " + r6("sum(n * (y1 - y0)) / sum(n) AS ate") + ", count(*) AS n_strata FROM k")
def stratified_ate(spark, sf_dir):
    return rounded(effects.stratified(treated(spark, sf_dir)))


@query(STRATA + " SELECT " + r6("sum(n * y1) / sum(n) AS y1", "sum(n * y0) / sum(n) AS y0", "sum(n * y1) / sum(n) - sum(n * y0) / sum(n) AS ate") + " FROM k")
def g_formula(spark, sf_dir):
    return rounded(effects.g_formula(treated(spark, sf_dir)))


@query(STRATA + " SELECT " + r6("sum(n1 * y1 / e) / sum(n1 / e) - sum(n0 * y0 / (1 - e)) / sum(n0 / (1 - e)) AS ipw", "sum(n * (y1 - y0)) / sum(n) AS aipw") + " FROM k")
def weighted_ate(spark, sf_dir):
    return rounded(effects.weighted(treated(spark, sf_dir)))


@query(f"""WITH {T_SQL}, w AS (SELECT avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS e FROM d), g AS (SELECT z, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS e FROM d GROUP BY z)
SELECT z, {r6('g.e AS effect')}, sign(g.e) <> sign(w.e) AS reversed FROM g, w UNION ALL SELECT NULL, {r6('e AS effect')}, false FROM w""")
def simpson_check(spark, sf_dir):
    return rounded(effects.simpson(treated(spark, sf_dir)))


@query(f"""WITH {T_SQL}, i AS (SELECT (q >= 25)::INT AS z, t, y / 1000 AS y FROM d) SELECT {r6(
    '(avg(y) FILTER (z = 1) - avg(y) FILTER (z = 0)) / (avg(t) FILTER (z = 1) - avg(t) FILTER (z = 0)) AS late')} FROM i""")
def iv_wald(spark, sf_dir):
    d = treated(spark, sf_dir).select("t", (F.col("y") / 1000).alias("y"), (F.col("q") >= 25).cast("int").alias("z"))
    return rounded(effects.wald(d))


@query(f"WITH {T_SQL} SELECT {r6('covar_pop(q, y) / covar_pop(q, tax * 1000) AS slope')} FROM d")
def iv_two_stage(spark, sf_dir):
    d = treated(spark, sf_dir).select(F.col("q").alias("z"), (F.col("tax") * 1000).alias("t"), "y")
    return rounded(effects.two_stage(d))


@query("""WITH m AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),
d AS (SELECT (o_orderpriority < '3')::INT AS t, (epoch(o_orderdate) >= (epoch(lo) + epoch(hi)) / 2)::INT AS post, o_totalprice AS y FROM orders, m)
SELECT """ + r6("(avg(y) FILTER (t = 1 AND post = 1) - avg(y) FILTER (t = 1 AND post = 0)) - (avg(y) FILTER (t = 0 AND post = 1) - avg(y) FILTER (t = 0 AND post = 0)) AS did") + " FROM d")
def diff_in_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("s", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    ends = o.agg(((F.min("s") + F.max("s")) / 2).alias("mid"))
    d = o.crossJoin(F.broadcast(ends))  # one row
    return rounded(effects.difference_in_differences(d.select((F.col("o_orderpriority") < "3").cast("int").alias("t"), (F.col("s") >= F.col("mid")).cast("int").alias("post"), F.col("o_totalprice").alias("y"))))


@query("""WITH d AS (SELECT l_quantity - 25 AS d, l_extendedprice AS y FROM lineitem), n AS (SELECT y, d >= 0 AS up, 1 - abs(d) / 10 AS w FROM d WHERE abs(d) < 10)
SELECT """ + r6("sum(w * y) FILTER (up) / sum(w) FILTER (up) - sum(w * y) FILTER (NOT up) / sum(w) FILTER (NOT up) AS jump") + ", count(*) AS n FROM n")
def regression_discontinuity(spark, sf_dir):
    d = table(spark, sf_dir, LI).select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(effects.regression_discontinuity(d, 25.0, 10.0))


@query(f"""WITH {T_SQL}, s AS (SELECT avg(t) AS p, avg(y) FILTER (t = 1) AS y1, avg(y) FILTER (t = 0) AS y0, min(y) AS lo, max(y) AS hi FROM d)
SELECT {r6('y1 * p + lo * (1 - p) - (y0 * (1 - p) + hi * p) AS lower', 'y1 * p + hi * (1 - p) - (y0 * (1 - p) + lo * p) AS upper')} FROM s""")
def manski_bounds(spark, sf_dir):
    return rounded(effects.manski(treated(spark, sf_dir)))


@query(f"""WITH {T_SQL}, s AS (SELECT avg(yb) FILTER (t = 1) AS p1, avg(yb) FILTER (t = 0) AS p0, avg(t) AS px FROM d),
r AS (SELECT *, p1 / p0 AS rr, greatest(p1 / p0, p0 / p1) AS h, greatest(0, p1 - p0) AS lo, least(p1, 1 - p0) AS hi FROM s)
SELECT {r6('p1', 'p0', 'rr', 'p1 * (1 - p0) / (p0 * (1 - p1)) AS odds_ratio', 'h + sqrt(h * (h - 1)) AS e_value', 'px * (rr - 1) / (1 + px * (rr - 1)) AS excess_fraction',
  'lo AS pns_low', 'hi AS pns_high', 'lo / p1 AS pn_low', 'least(1, hi / p1) AS pn_high', 'lo / (1 - p0) AS ps_low', 'least(1, hi / (1 - p0)) AS ps_high')} FROM r""")
def risk_measures(spark, sf_dir):
    return rounded(effects.risks(treated(spark, sf_dir, (F.col("l_returnflag") == "R").cast("int").cast("double"))))


@query("""WITH d AS (SELECT (l_discount >= 0.05)::INT::DOUBLE AS t, l_quantity AS m, l_extendedprice / 1000 AS y FROM lineitem),
s AS (SELECT count(*) AS n, var_pop(t) AS tt, var_pop(m) AS mm, var_pop(y) AS yy, covar_pop(t, m) AS tm, covar_pop(t, y) AS ty, covar_pop(m, y) AS my FROM d),
c AS (SELECT *, tm / tt AS a, (my * tt - ty * tm) / (tt * mm - tm * tm) AS b, (ty * mm - my * tm) / (tt * mm - tm * tm) AS d FROM s),
v AS (SELECT *, (mm - a * tm) / (n - 2) / tt AS va, (yy - b * my - d * ty) / (n - 3) * tt / (tt * mm - tm * tm) AS vb FROM c)
SELECT """ + r6("a", "b", "d AS direct", "a * b AS indirect", "a * b + d AS total", "a * b / (a * b + d) AS share", "a * b / sqrt(b * b * va + a * a * vb) AS sobel_z") + " FROM v")
def mediation(spark, sf_dir):
    d = table(spark, sf_dir, LI).select((F.col("l_discount") >= 0.05).cast("int").alias("t"), F.col("l_quantity").alias("m"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(effects.mediation(d))


@query(f"""WITH {T_SQL}, r AS (SELECT t, y, row_number() OVER (PARTITION BY t ORDER BY y, ok * 10 + ln) AS r, count(*) OVER (PARTITION BY t) AS n FROM d),
k AS (SELECT * FROM r WHERE r > floor(n * 0.05) AND r <= n - floor(n * 0.05)) SELECT {r6('avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS ate')}, count(*) AS n FROM k""")
def trimmed_ate(spark, sf_dir):
    return rounded(effects.trimmed(treated(spark, sf_dir), 0.05))


@query(f"""WITH {T_SQL}, c AS (SELECT t, ls AS m, count(*) AS n, avg(y) AS ym FROM d GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY t) AS pm, sum(n) OVER (PARTITION BY t) / sum(n) OVER () AS pt FROM c),
g AS (SELECT m, sum(ym * pt) / sum(pt) AS g FROM p GROUP BY m) SELECT t, {r6('sum(pm * g) AS y_do')} FROM p JOIN g USING (m) GROUP BY t""")
def front_door(spark, sf_dir):
    return rounded(effects.front_door(treated(spark, sf_dir).withColumn("m", F.col("ls"))))


@query("""WITH d AS (SELECT (c_mktsegment = 'BUILDING')::INT AS t, c_acctbal AS x, c_nationkey::DOUBLE AS y, c_custkey AS k FROM customer),
b AS (SELECT a.k, a.y, a.x, (SELECT c.x FROM d c WHERE c.t = 0 ORDER BY abs(c.x - a.x), c.x LIMIT 1) AS mx FROM d a WHERE a.t = 1),
m AS (SELECT b.k, b.y, b.x, b.mx, CASE WHEN mx <= b.x THEN max(c.k) ELSE min(c.k) END AS mk FROM b JOIN d c ON c.t = 0 AND c.x = mx GROUP BY b.k, b.y, b.x, b.mx)
SELECT """ + r6("avg(m.y - c.y) AS att") + ", count(*) AS n1 FROM m JOIN d c ON c.k = m.mk AND c.t = 0")
def nearest_match_att(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("t"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_custkey").alias("k"))
    return rounded(effects.nearest_match(c, "x", "k"))


@query(f"""WITH {HOURLY}, g AS (SELECT series, corr(v, t) AS r, count(*) AS n FROM s GROUP BY series), p AS (SELECT series, round(exp(-abs(atanh(r)) * sqrt(n - 3)), 9) AS p FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY p, series) AS i, count(*) OVER () AS m FROM p)
SELECT series, p, p < 0.05 / m AS bonferroni, max(p * (m - i + 1)) OVER (ORDER BY i) < 0.05 AS holm, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < 0.05 AS bh FROM r""")
def multiple_tests(spark, sf_dir):
    """Corrections of a bound on the trend tests' p-values, one test a series."""
    g = summed(spark, sf_dir).groupBy("series").agg(F.corr("v", F.col("t").cast("double")).alias("r"), F.count("*").alias("n"))
    return effects.adjusted_p(g.select("series", F.round(F.exp(-F.abs(F.atanh("r")) * F.sqrt(F.col("n") - 3)), 9).alias("p")))


# ---------------------------------------------------------------- time series

CENTRED = "c AS (SELECT series, t, v, v - avg(v) OVER (PARTITION BY series) AS d FROM s)"


@query(f"""WITH {HOURLY}, {CENTRED}, l AS (SELECT series, k::INT AS lag, d, CASE k WHEN 1 THEN lead(d, 1) OVER w WHEN 2 THEN lead(d, 2) OVER w WHEN 3 THEN lead(d, 3) OVER w END AS e
  FROM c, (VALUES (1), (2), (3)) AS q(k) WINDOW w AS (PARTITION BY series, k ORDER BY t)) SELECT series, lag, {r6('sum(d * e) / sum(d * d) AS acf')} FROM l GROUP BY series, lag""")
def autocorrelation(spark, sf_dir):
    return rounded(series.autocorrelation(summed(spark, sf_dir), 3))


@query(f"""WITH {HOURLY}, {CENTRED}, q AS (SELECT series, sum(d * d) AS s FROM c GROUP BY series),
p AS (SELECT x.series AS x, y.series AS y, sum(x.d * y.d) AS p FROM c x JOIN c y ON x.t = y.t + 2 AND x.series <> y.series GROUP BY 1, 2)
SELECT x, y, {r6('p / sqrt(a.s * b.s) AS ccf')} FROM p JOIN q a ON a.series = x JOIN q b ON b.series = y""")
def cross_correlation(spark, sf_dir):
    return rounded(series.cross_correlation(summed(spark, sf_dir), 2))


@query(f"WITH {DAILY} SELECT series, t, {r6('v', 'avg(v) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ma')} FROM s")
def moving_average(spark, sf_dir):
    return rounded(series.moving_average(summed(spark, sf_dir, 86400), 3))


@query(f"""WITH {DAILY}, w AS (SELECT series, t, avg(v) OVER w AS mean, var_samp(v) OVER w AS var, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT series, t, {r6('mean')}, round(var, 4) + 0.0 AS var FROM w WHERE n = 7""")
def sliding_stats(spark, sf_dir):
    s = series.sliding_stats(summed(spark, sf_dir, 86400), 7)
    return rounded(s.withColumn("var", F.round("var", 4)))


@query(f"""WITH {DAILY}, {CENTRED}, r AS (SELECT series, sum(d) OVER (PARTITION BY series ORDER BY t) / stddev_samp(v) OVER (PARTITION BY series) AS c FROM c)
SELECT series, {r6('max(abs(c)) / sqrt(count(*)) AS cusum')} FROM r GROUP BY series""")
def cusum(spark, sf_dir):
    return rounded(series.cusum(summed(spark, sf_dir, 86400)))


@query(f"""WITH {HOURLY}, {CENTRED}, i AS (SELECT *, row_number() OVER w - 1 AS i, lead(v) OVER w - v AS d1, lag(d) OVER w AS b, sum(d) OVER w AS cum FROM c WINDOW w AS (PARTITION BY series ORDER BY t)),
j AS (SELECT *, lead(d1) OVER (PARTITION BY series ORDER BY t) - d1 AS d2 FROM i),
a AS (SELECT series, sqrt(avg(v * v)) AS rms, coalesce(sum(((d >= 0) <> (b >= 0))::INT), 0)::BIGINT AS z, regr_slope(v, i) AS slope, sum((d - b) ** 2) / sum(d * d) AS dw,
  sum(cum * cum) / (count(*)::DOUBLE ** 2 * var_pop(v)) AS kpss, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM j GROUP BY series)
SELECT series, {r6('rms')}, z AS zero_crossings, {r6('slope', 'dw AS durbin_watson', 'kpss')}, round(v0, 4) + 0.0 AS activity, {r6('sqrt(v1 / v0) AS mobility', 'sqrt(v2 / v1) / sqrt(v1 / v0) AS complexity')} FROM a""")
def shape_stats(spark, sf_dir):
    return rounded(series.shape_stats(summed(spark, sf_dir)).withColumn("activity", F.round("activity", 4)))


@query(f"""WITH {DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i FROM s), b AS (SELECT series, regr_slope(v, i) AS b FROM i GROUP BY series)
SELECT series, t, {r6('v - b * i AS v')} FROM i JOIN b USING (series)""")
def detrended(spark, sf_dir):
    return rounded(series.detrended(summed(spark, sf_dir, 86400)))


@query(f"""WITH {HOURLY}, e AS (SELECT series, t, v AS past, lead(v) OVER w AS nxt, lead(t) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)), f AS (SELECT * FROM e WHERE t2 = t + 1),
m AS (SELECT x.series AS target, y.series AS source, count(*) AS n, var_pop(x.past) AS xx, var_pop(y.past) AS zz, var_pop(x.nxt) AS yy, covar_pop(x.past, y.past) AS xz, covar_pop(x.past, x.nxt) AS xy, covar_pop(y.past, x.nxt) AS zy
  FROM f x JOIN f y USING (t) WHERE x.series <> y.series GROUP BY 1, 2),
b AS (SELECT *, (xy * zz - zy * xz) / nullif(xx * zz - xz * xz, 0) AS b1, (zy * xx - xy * xz) / nullif(xx * zz - xz * xz, 0) AS b2 FROM m),
r AS (SELECT *, yy - b1 * xy - b2 * zy AS u, yy - xy * xy / nullif(xx, 0) AS o FROM b) SELECT target, source, n, {r6('CASE WHEN n > 3 THEN (o - u) / nullif(u, 0) * (n - 3) END AS f_stat')} FROM r""")
def granger_lag1(spark, sf_dir):
    return rounded(series.granger_lag1(summed(spark, sf_dir)))


# ---------------------------------------------------------------- graphs: trade between nations

TRADE = """w AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), e AS (SELECT src, dst FROM w WHERE n > (SELECT 1.1 * avg(n) FROM w))"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src: the customer's nation, dst: the supplier's, where the count is a tenth over the mean.

    The threshold is how a matrix of weights becomes a graph; without it all nations are linked.
    """
    li = table(spark, sf_dir, LI).select("l_orderkey", "l_suppkey")
    j = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    j = j.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), "c_custkey")
    j = j.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    w = j.filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return w.withColumn("m", F.avg("n").over(Window.partitionBy())).filter("n > 1.1 * m").select("src", "dst")


@query(f"""WITH {TRADE} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node""")
def degrees(spark, sf_dir):
    return graph.degrees(trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT count(*) AS n_edges, {r6('count(b.src) / count(*) AS reciprocity')} FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src")
def reciprocity(spark, sf_dir):
    return rounded(graph.reciprocity(trade(spark, sf_dir)))


@query(f"WITH {TRADE} SELECT count(*) AS n_ffl FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.dst")
def feed_forward_loops(spark, sf_dir):
    return graph.feed_forward_loops(trade(spark, sf_dir))


@query(f"""WITH {TRADE}, p AS (SELECT a.src AS x, b.src AS y, count(*) AS k FROM e a JOIN e b USING (dst) WHERE a.src < b.src GROUP BY 1, 2) SELECT coalesce(sum(k * (k - 1) // 2), 0)::BIGINT AS n_bifan FROM p""")
def bifans(spark, sf_dir):
    return graph.bifans(trade(spark, sf_dir))


@query(f"""WITH {TRADE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), n AS (SELECT a AS n, b AS m FROM u UNION ALL SELECT b, a FROM u),
d AS (SELECT n, count(*) AS k FROM n GROUP BY n), c AS (SELECT p.n, count(*) AS c FROM n p JOIN n q ON p.n = q.n AND p.m < q.m JOIN u ON u.a = p.m AND u.b = q.m GROUP BY p.n)
SELECT n AS node, k AS degree, {r6('2 * coalesce(c, 0) / (k * (k - 1)) AS clustering')} FROM d LEFT JOIN c USING (n) WHERE k > 1""")
def clustering(spark, sf_dir):
    return rounded(graph.clustering(trade(spark, sf_dir)))


@query(f"WITH {TRADE}, d AS (SELECT src, count(*) AS k FROM e GROUP BY src) SELECT {r6('ln(sum(k)) - sum(k * ln(k)) / sum(k) AS h')} FROM d")
def degree_entropy(spark, sf_dir):
    return rounded(graph.degree_entropy(trade(spark, sf_dir)))


@query(f"""WITH RECURSIVE {TRADE}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS c FROM n), w AS MATERIALIZED (SELECT src, dst, 1 / count(*) OVER (PARTITION BY src) AS w FROM e),
r AS (SELECT 0 AS i, node, 1.0::DOUBLE / c AS rank FROM n, c UNION ALL SELECT i, node, 0.15 / c + 0.85 * g FROM (SELECT i + 1 AS i, n.node, c.c, coalesce((SELECT sum(q.rank * w.w) FROM w JOIN (SELECT * FROM r) q ON q.node = w.src WHERE w.dst = n.node), 0) AS g
  FROM n, c, (SELECT DISTINCT i FROM r) WHERE i < 20)) SELECT node, {r6('rank')} FROM r WHERE i = 20""".replace("w AS (SELECT c_nationkey", "w0 AS (SELECT c_nationkey").replace("FROM w WHERE n > (SELECT 1.1 * avg(n) FROM w)", "FROM w0 WHERE n > (SELECT 1.1 * avg(n) FROM w0)"))
def page_rank(spark, sf_dir):
    return rounded(graph.page_rank(trade(spark, sf_dir), 20))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey + 100 AS a, n_regionkey AS b FROM nation), p AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS node, x AS o FROM p UNION SELECT p.y, r.o FROM r JOIN p ON p.x = r.node) SELECT node, min(o) AS component FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("src"), F.col("n_regionkey").alias("dst"))
    return components.connected_components(e)


CHAIN = "e AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 3 FROM part)"


@query(f"WITH RECURSIVE {CHAIN}, r AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(hops)::INT AS hops FROM r GROUP BY node")
def descendants(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    e = p.select(k.alias("src"), (k * 2).alias("dst")).unionByName(p.select(k.alias("src"), (k * 3).alias("dst")))
    return graph.descendants(e, spark.createDataFrame([(1,)], "node long"))


DAG = "e AS (SELECT DISTINCT l_linenumber AS src, l_linenumber + 1 + 2 * (l_orderkey % 2)::INT AS dst FROM lineitem)"


def _dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, LI)
    e = li.select(F.col("l_linenumber").alias("src"), (F.col("l_linenumber") + 1 + 2 * (F.col("l_orderkey") % 2).cast("int")).alias("dst"))
    return e.distinct()


@query(f"""WITH {DAG} SELECT p.src AS a, p.dst AS c, q.src AS b FROM e p JOIN e q ON p.dst = q.dst AND p.src < q.src WHERE NOT EXISTS (SELECT 1 FROM e x WHERE least(x.src, x.dst) = p.src AND greatest(x.src, x.dst) = q.src)""")
def v_structures(spark, sf_dir):
    return graph.v_structures(_dag(spark, sf_dir))


@query(f"WITH {DAG} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e UNION SELECT p.src, q.src FROM e p JOIN e q USING (dst) WHERE p.src < q.src")
def moral_graph(spark, sf_dir):
    return graph.moral_graph(_dag(spark, sf_dir))


@query(f"WITH {DAG} SELECT src, dst FROM e WHERE dst NOT IN (3, 4)")
def mutilated_graph(spark, sf_dir):
    return graph.mutilated(_dag(spark, sf_dir), spark.createDataFrame([(3,), (4,)], "node int"))


# Whole tables, with links that grow: part - supplier, and supplier -> order <- customer. Kinds of nodes are told apart by an offset.

FAR = 1_000_000_000_000


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey + {FAR} AS p FROM lineitem), b AS (SELECT s AS x, p AS y FROM e UNION ALL SELECT p, s FROM e),
r AS (SELECT s AS node, s AS o FROM e UNION SELECT b.y, r.o FROM r JOIN b ON b.x = r.node) SELECT node, min(o) AS component FROM r GROUP BY node""")
def connected_components_supply(spark, sf_dir):
    """Suppliers have the smaller numbers, so the smallest node of a component is one."""
    li = table(spark, sf_dir, LI)
    return components.connected_components(li.select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") + F.lit(FAR)).alias("dst")))


CAUSES = f"e AS (SELECT DISTINCT l_suppkey::BIGINT AS src, l_orderkey + {2 * FAR} AS dst FROM lineitem UNION ALL SELECT o_custkey + {FAR}, o_orderkey + {2 * FAR} FROM orders)"


def _causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, LI), table(spark, sf_dir, "orders")
    e = li.select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_orderkey") + F.lit(2 * FAR)).alias("dst"))
    e = e.repartition(tasks_for(spark, li.count()), "src", "dst").distinct()
    return e.unionByName(o.select((F.col("o_custkey") + F.lit(FAR)).alias("src"), (F.col("o_orderkey") + F.lit(2 * FAR)).alias("dst")))


@query(f"WITH {CAUSES} SELECT p.dst AS c, count(*) AS n, min(p.src) AS first_cause FROM e p JOIN e q ON p.dst = q.dst AND p.src < q.src GROUP BY p.dst")
def v_structures_orders(spark, sf_dir):
    """No two causes of an order are linked, so each pair is one; counted by order."""
    return graph.v_structures(_causes(spark, sf_dir)).groupBy("c").agg(F.count("*").alias("n"), F.min("a").alias("first_cause"))


@query(f"WITH {CAUSES} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e UNION SELECT p.src, q.src FROM e p JOIN e q USING (dst) WHERE p.src < q.src")
def moral_graph_orders(spark, sf_dir):
    return graph.moral_graph(_causes(spark, sf_dir))


@query(f"WITH {CAUSES} SELECT src, dst FROM e WHERE dst NOT IN ({2 * FAR + 1}, {2 * FAR + 2})")
def mutilated_graph_orders(spark, sf_dir):
    return graph.mutilated(_causes(spark, sf_dir), spark.createDataFrame([(2 * FAR + 1,), (2 * FAR + 2,)], "node long"))


# ---------------------------------------------------------------- searches and series statistics


@query()
def edge_stability(spark, sf_dir):
    return rounded(kernels.edge_stability(table(spark, sf_dir, LI), list(NUMERIC), ["l_orderkey", "l_linenumber"], replicates=20))


@query(f"""WITH RECURSIVE {DAILY}, i AS (SELECT series, t, v, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM s),
r AS (SELECT series, t, i, v AS s FROM i WHERE i = 1 UNION ALL SELECT i.series, i.t, i.i, 0.3 * i.v + 0.7 * r.s FROM r JOIN i ON i.series = r.series AND i.i = r.i + 1) SELECT series, t, {r6('s')} FROM r""")
def exponential_smoothing(spark, sf_dir):
    return rounded(kernels.exponential_smoothing(summed(spark, sf_dir, 86400), 0.3))


@query(f"""WITH {DAILY}, p AS (SELECT x.series AS x, y.series AS y, x.t, x.v AS a, y.v AS b FROM s x JOIN s y USING (t) WHERE x.series < y.series),
q AS (SELECT x, y, t, (a - avg(a) OVER w) / coalesce(nullif(stddev_samp(a) OVER w, 0), 1) AS a, (b - avg(b) OVER w) / coalesce(nullif(stddev_samp(b) OVER w, 0), 1) AS b FROM p WINDOW w AS (PARTITION BY x, y)),
d AS (SELECT i.x, i.y, i.t, abs(i.a - j.a) AS da, abs(i.b - j.b) AS db, row_number() OVER (PARTITION BY i.x, i.y, i.t ORDER BY greatest(abs(i.a - j.a), abs(i.b - j.b))) AS k FROM q i JOIN q j ON i.x = j.x AND i.y = j.y AND i.t <> j.t),
e AS (SELECT x, y, t, greatest(da, db) AS eps FROM d WHERE k = 3),
c AS (SELECT x, y, t, sum((da < eps)::INT)::INT AS na, sum((db < eps)::INT)::INT AS nb FROM d JOIN e USING (x, y, t) GROUP BY 1, 2, 3),
h AS (SELECT k::INT AS k, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / j), 0) AS psi FROM range(1, 200) AS k(k) LEFT JOIN range(1, 200) AS j(j) ON j.j < k.k GROUP BY 1),
m AS (SELECT x, y, count(*)::INT AS n, avg(ha.psi + hb.psi) AS s FROM c JOIN h ha ON ha.k = na + 1 JOIN h hb ON hb.k = nb + 1 GROUP BY 1, 2)
SELECT x, y, {r6('greatest(h3.psi + hn.psi - s, 0) AS mi')} FROM m JOIN h h3 ON h3.k = 3 JOIN h hn ON hn.k = n""")
def knn_mutual_information(spark, sf_dir):
    return rounded(kernels.knn_information(summed(spark, sf_dir, 86400)))


@query(f"""WITH {DAILY}, p AS (SELECT x.series AS x, y.series AS y, x.t, x.v AS a, y.v AS b FROM s x JOIN s y USING (t) WHERE x.series < y.series),
d AS (SELECT i.x, i.y, i.t AS t1, j.t AS t2, abs(i.a - j.a) AS da, abs(i.b - j.b) AS db FROM p i JOIN p j ON i.x = j.x AND i.y = j.y),
w AS (SELECT x, y, coalesce(median(da) FILTER (da > 0), 1) AS wa, coalesce(median(db) FILTER (db > 0), 1) AS wb FROM d GROUP BY 1, 2),
k AS (SELECT x, y, t1, t2, exp(-da * da / (2 * wa * wa)) AS ka, exp(-db * db / (2 * wb * wb)) AS kb FROM d JOIN w USING (x, y)),
c AS (SELECT x, y, ka - avg(ka) OVER r - avg(ka) OVER q + avg(ka) OVER g AS ca, kb - avg(kb) OVER r - avg(kb) OVER q + avg(kb) OVER g AS cb FROM k
  WINDOW r AS (PARTITION BY x, y, t1), q AS (PARTITION BY x, y, t2), g AS (PARTITION BY x, y)) SELECT x, y, {r6('avg(ca * cb) AS hsic')} FROM c GROUP BY 1, 2""")
def hsic(spark, sf_dir):
    return rounded(kernels.hsic(summed(spark, sf_dir, 86400)))


@query(f"""WITH {HOURLY}, {binned_sql(4)}, {EMBED}, g AS (SELECT series, min(t) AS lo, max(t) - min(t) + 1 AS n FROM e GROUP BY 1),
y AS (SELECT series AS source, past AS yp, k AS shift, lo + (t - lo + floor(n * k / 20)::BIGINT) % n AS t FROM e JOIN g USING (series), range(0, 20) AS k(k)),
p AS (SELECT x.series AS target, y.source, y.shift, x.future AS xf, x.past AS xp, y.yp FROM e x JOIN y USING (t) WHERE x.series <> y.source), {te_sql('p', 'target, source, shift')},
o AS (SELECT target, source, te AS own FROM te WHERE shift = 0)
SELECT target, source, {r6('own AS te')}, {r6('(1 + sum((te.te >= own)::INT)) / (1 + count(*)) AS p')} FROM te JOIN o USING (target, source) WHERE shift > 0 GROUP BY target, source, own""")
def surrogate_te(spark, sf_dir):
    b = information.equal_width_bins(summed(spark, sf_dir), "v", 4, ["series"])
    return rounded(kernels.surrogate_te(b, shifts=19))


from infocausal.plans import adjust_queries, bootstrap_queries, community_queries, discovery_queries, kernel_queries, longitudinal_queries, measures, recurrence_queries, scm_queries, spectral_queries  # noqa: E402, F401  register their queries
