"""More named queries with equal SQL: statistics of samples and series, bounds, paths. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infocausal.operators import bounds, communities, information, interventions, kernels, paths, resampling, statistics, transfer
from infocausal.plans.catalogue import DAILY, EMBED, HOURLY, LI, T_SQL, TE_HOURLY, TRADE, binned_sql, query, r6, rounded, summed, table, te_sql, trade, treated

# ---------------------------------------------------------------- samples and series


@query(f"""WITH {DAILY}, c AS (SELECT series, v - avg(v) OVER (PARTITION BY series) AS d FROM s)
SELECT series, count(*) AS n, {r6('avg(d ** 3) / avg(d ** 2) ** 1.5 AS skewness', 'avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS kurtosis')} FROM c GROUP BY series""")
def shape(spark, sf_dir):
    return rounded(statistics.shape(summed(spark, sf_dir, 86400)))


@query(f"""WITH c AS (SELECT event_type AS series, value AS v, count(*) AS n FROM events GROUP BY 1, 2)
SELECT series, {r6('v')}, {r6('sum(n) OVER (PARTITION BY series ORDER BY v) / sum(n) OVER (PARTITION BY series) AS cdf')} FROM c""")
def empirical_cdf(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("value").alias("v"))
    return rounded(statistics.empirical_cdf(e))


@query(f"""WITH {T_SQL}, r AS (SELECT t, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS r FROM d),
u AS (SELECT sum(t)::BIGINT AS n1, sum(1 - t)::BIGINT AS n0, sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2 AS u FROM r),
c AS (SELECT y, sum(t) AS k1, sum(1 - t) AS k0, count(*)::DOUBLE AS k FROM d GROUP BY y),
g AS (SELECT sum(k ** 3 - k) AS ties FROM c),
x AS (SELECT max(abs(a - b)) AS ks FROM (SELECT sum(k1) OVER w / sum(k1) OVER () AS a, sum(k0) OVER w / sum(k0) OVER () AS b FROM c WINDOW w AS (ORDER BY y)))
SELECT n1, n0, {r6('u', '(u - n1::DOUBLE * n0 / 2) / sqrt(n1::DOUBLE * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))) AS z', 'ks', 'u / n1 / n0 AS auc')} FROM u, g, x""")
def two_samples(spark, sf_dir):
    return rounded(statistics.two_samples(treated(spark, sf_dir), "t", "y"))


@query("""WITH s AS (SELECT event_type AS series, count(value) AS n, max(value) - min(value) AS span, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1)
SELECT series, (ceil(log2(n)) + 1)::BIGINT AS sturges, ceil(2 * n ** (1 / 3))::BIGINT AS rice, greatest(ceil(span / (3.49 * sd / n ** (1 / 3))), 1)::BIGINT AS scott,
  greatest(ceil(span / (2 * iqr / n ** (1 / 3))), 1)::BIGINT AS freedman_diaconis FROM s""")
def bin_counts(spark, sf_dir):
    return statistics.bin_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("value").alias("v")))


@query(f"""WITH {HOURLY}, q AS (SELECT series, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM s GROUP BY series)
SELECT series, ((q[1] < v)::INT + (q[2] < v)::INT + (q[3] < v)::INT)::INT AS b, count(*) AS n FROM s JOIN q USING (series) GROUP BY 1, 2""")
def quantile_bins(spark, sf_dir):
    return statistics.quantile_bins(summed(spark, sf_dir), 4).groupBy("series", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {HOURLY}, d AS (SELECT * FROM (SELECT series, lag(v) OVER w AS x, v - lag(v) OVER w AS y FROM s WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE x IS NOT NULL),
m AS (SELECT series, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM d GROUP BY series)
SELECT series, n, {r6('xy / xx AS rho', 'xy / xx / sqrt((yy - xy * xy / xx) / (n - 2) / xx) AS statistic')} FROM m WHERE n > 2""")
def dickey_fuller(spark, sf_dir):
    return rounded(statistics.dickey_fuller(summed(spark, sf_dir)))


@query(f"""WITH {HOURLY}, i AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM s),
m AS (SELECT series, k, i // k AS b, avg(v) AS m FROM i, (VALUES (1), (2), (4), (8)) AS k(k) WHERE i < n - n % k GROUP BY 1, 2, 3), v AS (SELECT series, k, var_samp(m) AS s FROM m GROUP BY 1, 2)
SELECT series, {r6('1 + regr_slope(ln(s), ln(k)) / 2 AS hurst')} FROM v WHERE s > 0 GROUP BY series""")
def hurst(spark, sf_dir):
    return rounded(statistics.hurst(summed(spark, sf_dir)))


@query(f"""WITH {DAILY}, g AS (SELECT series, 0.2 * stddev_pop(v) AS r, count(*) AS n FROM s GROUP BY series),
x AS (SELECT series, row_number() OVER w AS i, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)),
p AS (SELECT a.series, a.i, n, count(*) AS c0, sum(coalesce((abs(a.v2 - b.v2) <= r)::INT, 0)) AS c1, sum((a.v2 IS NOT NULL AND b.v2 IS NOT NULL AND a.i <> b.i)::INT) AS a0
  FROM x a JOIN x b ON a.series = b.series JOIN g ON g.series = a.series WHERE abs(a.v0 - b.v0) <= r AND abs(a.v1 - b.v1) <= r GROUP BY 1, 2, 3)
SELECT series, {r6('-ln(nullif(sum(greatest(c1 - 1, 0)), 0) / nullif(sum(a0), 0)) AS sample_entropy',
  'sum(ln(c0 / (n - 1))) / any_value(n - 1) - sum(CASE WHEN c1 > 0 THEN ln(c1 / (n - 2)) END) / any_value(n - 2) AS approximate_entropy')} FROM p GROUP BY series""")
def regularity(spark, sf_dir):
    return rounded(statistics.regularity(summed(spark, sf_dir, 86400)))


@query()
def lz_complexity(spark, sf_dir):
    """The parsing has no plain SQL; the tests hold it against a parsing by hand."""
    return rounded(statistics.lz_complexity(summed(spark, sf_dir)))


FLAGS = "c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {FLAGS}, t AS (SELECT sum(n) AS t FROM c), h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM (SELECT x, sum(n) AS n FROM c GROUP BY x), t) AS hx,
  (SELECT -sum(n / t * ln(n / t)) FROM (SELECT y, sum(n) AS n FROM c GROUP BY y), t) AS hy, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hxy)
SELECT {r6('hx', 'hy', 'hxy', 'greatest(hx + hy - hxy, 0) AS mi', 'greatest(hx + hy - hxy, 0) / sqrt(hx * hy) AS nmi', 'greatest(hx + hy - hxy, 0) / hx AS uncertainty', '2 * hxy - hx - hy AS variation')} FROM h""")
def normalized_information(spark, sf_dir):
    return rounded(statistics.normalized_information(table(spark, sf_dir, LI), "l_returnflag", "l_linestatus"))


@query(f"""WITH {FLAGS} SELECT x AS l_returnflag, y AS l_linestatus, n, {r6('n / sum(n) OVER () AS joint', 'n / sum(n) OVER (PARTITION BY y) AS x_given_y', 'n / sum(n) OVER (PARTITION BY x) AS y_given_x')} FROM c""")
def joint_distribution(spark, sf_dir):
    return rounded(statistics.joint_distribution(table(spark, sf_dir, LI), "l_returnflag", "l_linestatus"))


@query(f"WITH {HOURLY} SELECT series, t // 6 AS t, {r6('avg(v) AS v')}, count(*) AS n FROM s GROUP BY 1, 2")
def downsampled(spark, sf_dir):
    return rounded(statistics.downsampled(summed(spark, sf_dir), 6))


WINDOWED = f"""WITH {HOURLY}, e AS (SELECT series, t, v AS past, lead(v) OVER w AS nxt, lead(t) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)), f AS (SELECT * FROM e WHERE t2 = t + 1),
m AS (SELECT k AS win, x.series AS target, y.series AS source, count(*) AS n, var_pop(x.past) AS xx, var_pop(y.past) AS zz, var_pop(x.nxt) AS yy, covar_pop(x.past, y.past) AS xz, covar_pop(x.past, x.nxt) AS xy, covar_pop(y.past, x.nxt) AS zy
  FROM f x JOIN f y USING (t), LATERAL (SELECT unnest(range(ceil((x.t - 167) / 84)::BIGINT, x.t // 84 + 1)) AS k) WHERE x.series <> y.series GROUP BY 1, 2, 3),
b AS (SELECT *, (xy * zz - zy * xz) / nullif(xx * zz - xz * xz, 0) AS b1, (zy * xx - xy * xz) / nullif(xx * zz - xz * xz, 0) AS b2 FROM m),
r AS (SELECT *, yy - b1 * xy - b2 * zy AS u, yy - xy * xy / nullif(xx, 0) AS o FROM b), g AS (SELECT win, target, source, n, CASE WHEN n > 3 THEN (o - u) / nullif(u, 0) * (n - 3) END AS f_stat FROM r)"""


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.windowed_granger(summed(spark, sf_dir), 168, 84)


@query(f"{WINDOWED} SELECT win, target, source, n, {r6('f_stat')} FROM g WHERE n > 8")
def granger_windows(spark, sf_dir):
    return rounded(_windowed(spark, sf_dir).filter("n > 8"))


@query(f"""{WINDOWED}, j AS (SELECT target, source, win, f_stat - lag(f_stat) OVER (PARTITION BY target, source ORDER BY win) AS jump FROM g WHERE n > 8),
k AS (SELECT *, stddev_samp(jump) OVER (PARTITION BY target, source) AS sd FROM j) SELECT target, source, win, {r6('jump')} FROM k WHERE abs(jump) > 1.2 * sd""")
def granger_change_points(spark, sf_dir):
    return rounded(statistics.change_points(_windowed(spark, sf_dir).filter("n > 8"), 1.2))


# ---------------------------------------------------------------- bounds and sensitivity

MANSKI = f"WITH {T_SQL}, s AS (SELECT avg(t) AS p, avg(y) FILTER (t = 1) AS y1, avg(y) FILTER (t = 0) AS y0, min(y) AS lo, max(y) AS hi FROM d)"


@query(MANSKI + " SELECT " + r6(
    "greatest(y1 * p + lo * (1 - p) - (y0 * (1 - p) + hi * p), 0) AS mtr_low", "y1 * p + hi * (1 - p) - (y0 * (1 - p) + lo * p) AS mtr_high",
    "y1 * p + lo * (1 - p) - (y0 * (1 - p) + hi * p) AS mts_low", "y1 - y0 AS mts_high", "0.0::DOUBLE AS both_low", "y1 - y0 AS both_high") + " FROM s")
def monotone_bounds(spark, sf_dir):
    return rounded(bounds.monotone(treated(spark, sf_dir)))


_P = ", ".join(f"avg((yb = {y} AND t = {t})::INT) FILTER (z = {z}) AS p{y}{t}{z}" for y in (0, 1) for t in (0, 1) for z in (0, 1))


@query(f"""WITH {T_SQL}, i AS (SELECT (q >= 25)::INT AS z, t, yb FROM d), p AS (SELECT {_P} FROM i)
SELECT {r6('''greatest(p110 + p001 - 1, p111 + p000 - 1, p110 - p111 - p101 - p010 - p100, p111 - p110 - p100 - p011 - p101, -p011 - p101, -p010 - p100,
  p001 - p011 - p101 - p010 - p000, p000 - p010 - p100 - p011 - p001) AS lower''', '''least(1 - p010 - p101, 1 - p011 - p100, -p010 + p011 + p001 + p110 + p000, -p011 + p111 + p001 + p010 + p000,
  p111 + p001, p110 + p000, -p101 + p111 + p001 + p110 + p100, -p100 + p110 + p000 + p111 + p101) AS upper''')},
  greatest(greatest(p000, p001) + greatest(p100, p101), greatest(p010, p011) + greatest(p110, p111)) <= 1 AS consistent FROM p""")
def instrument_bounds(spark, sf_dir):
    d = table(spark, sf_dir, LI).select((F.col("l_quantity") >= 25).cast("int").alias("z"), (F.col("l_discount") >= 0.05).cast("int").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(bounds.instrument_bounds(d))


@query("WITH d AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS y FROM lineitem) SELECT " + r6(
    "count(y) / count(*) AS seen", "avg(y) * (count(y) / count(*)) + min(y) * (1 - count(y) / count(*)) AS lower", "avg(y) * (count(y) / count(*)) + max(y) * (1 - count(y) / count(*)) AS upper") + " FROM d")
def missing_outcome_bounds(spark, sf_dir):
    return rounded(bounds.missing_outcomes(table(spark, sf_dir, LI).select(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("y"))))


@query(f"""WITH {T_SQL}, q AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q, unnest(quantile_cont(y, [0.1, 0.5, 0.9]) FILTER (t = 1)) AS y1, unnest(quantile_cont(y, [0.1, 0.5, 0.9]) FILTER (t = 0)) AS y0 FROM d)
SELECT {r6('q', 'y1', 'y0', 'y1 - y0 AS effect')} FROM q""")
def quantile_effects(spark, sf_dir):
    return rounded(bounds.quantile_effects(treated(spark, sf_dir), [0.1, 0.5, 0.9]))


@query(f"""WITH {T_SQL}, m AS (SELECT min(y) AS lo, max(y) AS hi FROM d), c AS (SELECT least(floor((y - lo) / ((hi - lo) / 200)), 199)::INT AS b, sum(t) AS k1, sum(1 - t) AS k0 FROM d, m GROUP BY 1),
f AS (SELECT b, sum(k1) OVER (ORDER BY b) / sum(k1) OVER () - sum(k0) OVER (ORDER BY b) / sum(k0) OVER () AS d, coalesce(lead(b) OVER (ORDER BY b), b + 1) AS n FROM c),
g AS (SELECT d, sum(d * (n - b)) OVER (ORDER BY b) AS s FROM f) SELECT {r6('max(d) AS first_order', 'max(s) / 200 AS second_order')} FROM g""")
def dominance(spark, sf_dir):
    return rounded(bounds.dominance(treated(spark, sf_dir)))


RISK = f"""WITH {T_SQL}, s AS (SELECT avg(yb) FILTER (t = 1) AS p1, avg(yb) FILTER (t = 0) AS p0, sum(yb) FILTER (t = 1) AS a, sum(yb) FILTER (t = 0) AS c, sum(t) AS n1, sum(1 - t) AS n0, avg(yb) AS p FROM d),
r AS (SELECT *, p1 / p0 AS rr, 1.959963984540054 * sqrt(1 / a - 1 / n1 + 1 / c - 1 / n0) AS e, p1 - p0 AS rd FROM s)"""


@query(RISK + " SELECT " + r6("rr", "rr * exp(-e) AS rr_low", "rr * exp(e) AS rr_high", "1 - 1 / rr AS fraction", "1 - 1 / (rr * exp(-e)) AS fraction_low", "1 - 1 / (rr * exp(e)) AS fraction_high",
                               "1 - p0 / p AS population_fraction", "rd AS risk_difference", "1 / nullif(abs(rd), 0) AS number_needed") + " FROM r")
def attributable_fraction(spark, sf_dir):
    return rounded(bounds.attributable(treated(spark, sf_dir, (F.col("l_returnflag") == "R").cast("int"))))


@query(f"""WITH {T_SQL}, s AS (SELECT z, count(*) AS n, sum(t) AS n1, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS c FROM d GROUP BY z)
SELECT z, n, {r6('c AS cate', 'sum(c * n) OVER () / sum(n) OVER () AS ate', 'sum(c * n1) OVER () / sum(n1) OVER () AS att', 'sum(c * (n - n1)) OVER () / sum(n - n1) OVER () AS atu')} FROM s WHERE c IS NOT NULL""")
def subgroup_effects(spark, sf_dir):
    return rounded(bounds.subgroup_effects(treated(spark, sf_dir)))


@query(f"""WITH {T_SQL}, s AS (SELECT avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS d, var_samp(y) FILTER (t = 1) AS va, var_samp(y) FILTER (t = 0) AS vb, sum(t)::BIGINT AS n1, sum(1 - t)::BIGINT AS n0 FROM d),
p AS (SELECT *, d / sqrt(((n1 - 1) * va + (n0 - 1) * vb) / (n1 + n0 - 2)) AS c FROM s)
SELECT {r6('c AS cohens_d', 'c * (1 - 3 / (4 * (n1 + n0) - 9)) AS hedges_g', 'd / sqrt(vb) AS glass_delta', 'd / sqrt(va / n1 + vb / n0) AS welch_t')}, n1 + n0 AS n FROM p""")
def effect_size(spark, sf_dir):
    return rounded(bounds.effect_size(treated(spark, sf_dir)))


@query(f"""WITH {T_SQL}, c AS (SELECT z, t, count(*) AS n, sum(y) AS s FROM d GROUP BY 1, 2), w AS (SELECT t, n, s, sum(n) OVER (PARTITION BY t) / sum(n) OVER () / (n / sum(n) OVER (PARTITION BY z)) AS w FROM c),
m AS (SELECT t, sum(w * s) / sum(w * n) AS m, sum(w * n) AS w1, sum(w * w * n) AS w2 FROM w GROUP BY t)
SELECT {r6('max(m) FILTER (t = 0) AS intercept', 'max(m) FILTER (t = 1) - max(m) FILTER (t = 0) AS slope', 'sum(w1) * sum(w1) / sum(w2) AS effective_n')} FROM m""")
def marginal_structural(spark, sf_dir):
    return rounded(bounds.marginal_structural(treated(spark, sf_dir)))


MED = "WITH d AS (SELECT (l_discount >= 0.05)::INT AS t, l_quantity AS m, l_extendedprice / 1000 AS y FROM lineitem)"


def _mediated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, LI).select((F.col("l_discount") >= 0.05).cast("int").alias("t"), F.col("l_quantity").alias("m"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(MED + """, s AS (SELECT avg(m) AS mm, avg(m) FILTER (t = 0) AS m0, avg(m) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS y0, avg(y) FILTER (t = 1) AS y1,
  covar_pop(m, y) FILTER (t = 0) / var_pop(m) FILTER (t = 0) AS b0, covar_pop(m, y) FILTER (t = 1) / var_pop(m) FILTER (t = 1) AS b1 FROM d),
e AS (SELECT y1 + b1 * (mm - m1) - (y0 + b0 * (mm - m0)) AS cde, y1 + b1 * (m0 - m1) - y0 AS nde, b1 * (m1 - m0) AS nie, y1 - y0 AS total, b1 - b0 AS interaction FROM s)
SELECT """ + r6("cde", "nde", "nie", "total", "nie / total AS mediated", "(total - cde) / total AS eliminated", "interaction") + " FROM e")
def interacting_mediation(spark, sf_dir):
    return rounded(bounds.interacting_mediation(_mediated(spark, sf_dir)))


@query(MED + """, s AS (SELECT var_pop(t) AS tt, covar_pop(t, m) AS tm, covar_pop(t, y) AS ty, var_pop(m) AS mm, var_pop(y) AS yy, covar_pop(m, y) AS my FROM d),
r AS (SELECT tm / tt AS a, sqrt(yy - ty * ty / tt) AS s1, sqrt(mm - tm * tm / tt) AS s2, (my - ty * tm / tt) / (sqrt(yy - ty * ty / tt) * sqrt(mm - tm * tm / tt)) AS r FROM s)
SELECT """ + r6("rho::DOUBLE AS rho", "a * s1 / s2 * (r - rho * sqrt((1 - r * r) / (1 - rho * rho))) AS nie", "r AS zero_at") + " FROM r, (VALUES (-0.5), (0.0), (0.5)) AS k(rho)")
def mediator_sensitivity(spark, sf_dir):
    return rounded(bounds.mediator_sensitivity(_mediated(spark, sf_dir), [-0.5, 0.0, 0.5]))


@query(f"""WITH {T_SQL}, x AS (SELECT t, yb AS y, (ls = 'O')::INT AS u FROM d), s AS (SELECT u, count(*) AS n, avg(y) FILTER (t = 1) AS p1, avg(y) FILTER (t = 0) AS p0 FROM x GROUP BY u),
a AS (SELECT sum(n * (p1 - p0)) / sum(n) AS adjusted FROM s), c AS (SELECT avg(y) FILTER (t = 1) AS q1, avg(y) FILTER (t = 0) AS q0, avg(u) FILTER (t = 1) AS u1, avg(u) FILTER (t = 0) AS u0 FROM x)
SELECT {r6('q1 - q0 AS crude', 'adjusted', 'q1 - q0 - adjusted AS bias', 'greatest(q1 / q0, q0 / q1) AS needed', 'greatest(u1 / u0, u0 / u1) AS imbalance')}, greatest(u1 / u0, u0 / u1) >= greatest(q1 / q0, q0 / q1) AS could_explain FROM c, a""")
def confounding_bias(spark, sf_dir):
    d = treated(spark, sf_dir, (F.col("l_returnflag") == "R").cast("int")).withColumn("u", (F.col("ls") == "O").cast("int"))
    return rounded(bounds.confounding(d, "u"))


# ---------------------------------------------------------------- paths between nations

HOPS = f"WITH RECURSIVE {TRADE}, h AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT h.src, e.dst, h.hops + 1 FROM h JOIN e ON e.src = h.dst WHERE h.hops < 25 AND h.src <> e.dst), p AS (SELECT src, dst, min(hops)::INT AS hops FROM h GROUP BY 1, 2)"


@query(f"{HOPS} SELECT src, dst, hops FROM p")
def distances(spark, sf_dir):
    return paths.distances(trade(spark, sf_dir))


@query(f"""{HOPS}, n AS (SELECT count(DISTINCT x) AS nodes FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e))
SELECT nodes, count(*) AS pairs, {r6('avg(hops) AS mean_hops')}, max(hops) AS diameter, {r6('sum(1 / hops) / (nodes * (nodes - 1)) AS efficiency')} FROM p, n GROUP BY nodes""")
def path_summary(spark, sf_dir):
    return rounded(paths.path_summary(trade(spark, sf_dir)))


@query(f"""{HOPS}, n AS (SELECT DISTINCT x AS node FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e)), k AS (SELECT count(*) - 1 AS o FROM n), d AS (SELECT src AS node, count(*) AS r, sum(hops) AS h, sum(1 / hops) AS i FROM p GROUP BY 1)
SELECT node, {r6('coalesce(r / h * r / o, 0) AS closeness', 'coalesce(i / o, 0) AS harmonic')} FROM n LEFT JOIN d USING (node), k""")
def closeness(spark, sf_dir):
    return rounded(paths.closeness(trade(spark, sf_dir)))


@query(f"""WITH RECURSIVE {TRADE}, b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e),
r AS (SELECT DISTINCT 0 AS i, src AS node, 1.0::DOUBLE AS s FROM b UNION ALL SELECT i + 1, node, s FROM (SELECT r.i, b.dst AS node, sum(r.s) AS s FROM r JOIN b ON b.src = r.node WHERE r.i < 30 GROUP BY r.i, b.dst))
SELECT node, {r6('s / max(s) OVER () AS score')} FROM r WHERE i = 30""")
def eigenvector(spark, sf_dir):
    return rounded(paths.eigenvector(trade(spark, sf_dir), 30))


FLOWS = "w AS (SELECT o_orderpriority AS src, c_mktsegment AS dst, sum(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"""WITH {FLOWS}, p AS (SELECT *, w / sum(w) OVER () AS pt, w / sum(w) OVER (PARTITION BY src) AS st, sum(w) OVER (PARTITION BY src) / sum(w) OVER () AS so FROM w), n AS (SELECT count(DISTINCT src) AS n FROM w),
m AS (SELECT sum(st) / any_value(n) AS m FROM p, n GROUP BY dst)
SELECT {r6('-sum(pt * ln(pt)) AS flow_entropy', '-sum(so * st * ln(st)) AS node_entropy', '(SELECT -sum(m * ln(m)) FROM m) + sum(st * ln(st)) / any_value(n) AS effective_information')} FROM p, n""")
def network_entropy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(paths.network_entropy(o.groupBy(F.col("o_orderpriority").alias("src"), F.col("c_mktsegment").alias("dst")).agg(F.sum("o_totalprice").alias("w"))))


@query(f"""WITH {TRADE}, a AS (SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM e GROUP BY src) GROUP BY k), b AS (SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM e GROUP BY dst) GROUP BY k),
j AS (SELECT coalesce(a.n, 0) + 0.5 AS x, coalesce(b.n, 0) + 0.5 AS y FROM a FULL JOIN b USING (k)), q AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM j)
SELECT {r6('sum(p * ln(p / q)) AS kl', 'sum(p * ln(2 * p / (p + q))) / 2 + sum(q * ln(2 * q / (p + q))) / 2 AS js')} FROM q""")
def degree_divergence(spark, sf_dir):
    """Out-degrees against in-degrees."""
    e = trade(spark, sf_dir)
    return rounded(paths.degree_divergence(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query(f"""WITH {TRADE}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) - 1 AS m FROM e GROUP BY 1, 2), n AS (SELECT a AS x FROM p UNION SELECT b FROM p),
t AS (SELECT (ab.m IS NOT NULL)::INT + (ac.m IS NOT NULL)::INT + (bc.m IS NOT NULL)::INT AS links, coalesce(ab.m, 0) + coalesce(ac.m, 0) + coalesce(bc.m, 0) AS mutual
  FROM n i JOIN n j ON i.x < j.x JOIN n k ON j.x < k.x LEFT JOIN p ab ON ab.a = i.x AND ab.b = j.x LEFT JOIN p ac ON ac.a = i.x AND ac.b = k.x LEFT JOIN p bc ON bc.a = j.x AND bc.b = k.x)
SELECT links, mutual, count(*) AS n FROM t WHERE links >= 2 GROUP BY 1, 2""")
def triads(spark, sf_dir):
    return paths.triads(trade(spark, sf_dir))


@query(f"""WITH j AS (SELECT c_mktsegment AS x, c_nationkey AS y, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j),
a AS (SELECT -sum(n / t * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM j GROUP BY x), t), b AS (SELECT -sum(n / t * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM j GROUP BY y), t),
c AS (SELECT -sum(n / t * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM j, t)
SELECT {r6('2 * (a.h + b.h - c.h) / (a.h + b.h) AS nmi', '(t * (t - 1) / 2 + 2 * c.s - a.s - b.s) / (t * (t - 1) / 2) AS rand')} FROM a, b, c, t""")
def partition_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    part = lambda k: c.select(F.col("c_custkey").alias("node"), F.col(k).alias("community"))
    return rounded(paths.partition_agreement(part("c_mktsegment"), part("c_nationkey")))


# ---------------------------------------------------------------- searches with hidden causes, resampling


PLACED = f"{DAILY}, x AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM s)"


def drawn(*of: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(of)})), 1, 8))::BIGINT"


@query(f"""WITH {PLACED}, b AS (SELECT series, n, rep, j, {drawn('series', 'rep', 'j')} % n AS start FROM (SELECT DISTINCT series, n FROM x), range(1, 51) AS r(rep), range(0, 100) AS j(j) WHERE j <= (n - 1) // 5),
a AS (SELECT series, rep, (start + k) % n AS i FROM b, range(0, 5) AS k(k) WHERE j * 5 + k < n), m AS (SELECT series, rep, avg(v) AS m FROM a JOIN x USING (series, i) GROUP BY 1, 2)
SELECT series, {r6('quantile_cont(m, 0.025) AS low', 'quantile_cont(m, 0.975) AS high', 'stddev_samp(m) AS se')}, count(*) AS n FROM m GROUP BY series""")
def block_bootstrap_interval(spark, sf_dir):
    reps = resampling.block_bootstrap(summed(spark, sf_dir, 86400), 50, 5).groupBy("series", "rep").agg(F.avg("v").alias("m"))
    return rounded(resampling.percentile_interval(reps, ["series"], "m"))


@query(f"""WITH {PLACED}, r AS (SELECT series, i, n, v, rep, i = 0 OR {drawn('series', 'rep', 'i', "'new'")} % 5 = 0 AS begins, {drawn('series', 'rep', 'i', "'from'")} % n AS p FROM x, range(1, 51) AS r(rep)),
b AS (SELECT series, rep, n, i, last_value(CASE WHEN begins THEN p - i END IGNORE NULLS) OVER (PARTITION BY series, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM r),
m AS (SELECT b.series, b.rep, avg(x.v) AS m FROM b JOIN x ON x.series = b.series AND x.i = (b.i + b.d) % b.n GROUP BY 1, 2)
SELECT series, {r6('quantile_cont(m, 0.025) AS low', 'quantile_cont(m, 0.975) AS high', 'stddev_samp(m) AS se')}, count(*) AS n FROM m GROUP BY series""")
def stationary_bootstrap_interval(spark, sf_dir):
    reps = resampling.stationary_bootstrap(summed(spark, sf_dir, 86400), 50, 5).groupBy("series", "rep").agg(F.avg("v").alias("m"))
    return rounded(resampling.percentile_interval(reps, ["series"], "m"))


@query(f"""WITH {DAILY}, d AS (SELECT series, v, v - avg(v) OVER (PARTITION BY series) AS d FROM s)
SELECT series, {r6('avg(v) AS mean', 'sqrt(sum(d * d) / (count(*) * (count(*) - 1))) AS se', 'sum(d * d * d) / (6 * sum(d * d) ** 1.5) AS acceleration')} FROM d GROUP BY series""")
def jackknife_mean(spark, sf_dir):
    return rounded(resampling.jackknife_mean(summed(spark, sf_dir, 86400), ["series"], "v"))


@query(f"""WITH {PLACED}, r AS (SELECT series, rep, v, row_number() OVER (PARTITION BY series, rep ORDER BY {drawn('series', 'rep', 'i')}, i) AS k FROM x, range(1, 40) AS r(rep)),
c AS (SELECT series, rep, corr(v, l) AS c FROM (SELECT series, rep, v, lag(v) OVER (PARTITION BY series, rep ORDER BY k) AS l FROM r) GROUP BY 1, 2),
o AS (SELECT series, corr(v, l) AS observed FROM (SELECT series, v, lag(v) OVER (PARTITION BY series ORDER BY i) AS l FROM x) GROUP BY 1)
SELECT series, {r6('observed', 'avg(c) AS mean', '(observed - avg(c)) / stddev_samp(c) AS z', '(sum((c >= observed)::INT) + 1) / (count(*) + 1) AS p', 'observed - avg(c) AS corrected')} FROM c JOIN o USING (series) GROUP BY series, observed""")
def shuffled_autocorrelation(spark, sf_dir):
    """The correlation of neighbours against that of shuffled series."""
    from pyspark.sql.window import Window

    s = summed(spark, sf_dir, 86400)
    stat = lambda d, by, i: d.withColumn("l", F.lag("v").over(Window.partitionBy(*by).orderBy(i))).groupBy(*by).agg(F.corr("v", "l").alias("c"))
    return rounded(resampling.permutation_p(stat(s, ["series"], "t"), stat(resampling.shuffled(s, 39), ["series", "rep"], "i"), ["series"], "c"))


# ---------------------------------------------------------------- forms of transfer entropy

BINNED = f"{HOURLY}, {binned_sql(4)}, {EMBED}"


def _binned(spark: SparkSession, sf_dir: str, bins: int = 4) -> DataFrame:
    return information.equal_width_bins(summed(spark, sf_dir), "v", bins, ["series"])


SCAN = f"""WITH {BINNED}, p AS (SELECT x.series AS target, y.series AS source, k::INT AS lag, x.future AS xf, x.past AS xp, y.b AS yp FROM range(1, 5) AS r(k), e x JOIN b y ON y.t = x.t - k + 1 WHERE x.series <> y.series),
{te_sql('p', 'target, source, lag')}"""


@query(f"{SCAN} SELECT target, source, lag, n_obs, {r6('te')} FROM te")
def te_lag_scan(spark, sf_dir):
    return rounded(transfer.lag_scan(_binned(spark, sf_dir), 4))


@query(f"{SCAN}, best AS (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY round(te, 12) DESC, lag) AS k FROM te) SELECT target, source, lag, {r6('te')} FROM best WHERE k = 1")
def te_best_lag(spark, sf_dir):
    return rounded(transfer.best_lag(transfer.lag_scan(_binned(spark, sf_dir), 4)))


@query(f"""WITH {BINNED}, c AS (SELECT x.series AS target, y.series AS source, x.future AS xf, x.past AS xp, y.past AS yp, y.future AS yf, count(*) AS n FROM e x JOIN e y USING (t) WHERE x.series <> y.series GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY target, source) AS t, sum(n) OVER (PARTITION BY target, source, xf) AS f, sum(n) OVER (PARTITION BY target, source, xp) AS p, sum(n) OVER (PARTITION BY target, source, xf, xp) AS fp,
  sum(n) OVER (PARTITION BY target, source, xp, yp) AS py, sum(n) OVER (PARTITION BY target, source, xf, xp, yp) AS fpy, sum(n) OVER (PARTITION BY target, source, xp, yp, yf) AS pyy FROM c),
h AS (SELECT target, source, sum(n)::BIGINT AS n_obs, sum(n / t * ln(t / f)) AS h_next, sum(n / t * ln(p / fp)) AS h_rate, sum(n / t * ln(py / fpy)) AS h_both, sum(n / t * ln(pyy / n)) AS h_caused FROM k GROUP BY 1, 2),
r AS (SELECT *, greatest(h_rate - h_both, 0) AS te, greatest(h_both - h_caused, 0) AS instant FROM h)
SELECT target, source, n_obs, {r6('h_next', 'h_rate', 'te', 'te / nullif(h_rate, 0) AS normalized', 'te / nullif(h_next, 0) AS uncertainty', 'instant', 'te + instant AS directed', 'h_caused')} FROM r""")
def te_rates(spark, sf_dir):
    return rounded(transfer.rates(_binned(spark, sf_dir)))


@query(f"""WITH {BINNED}, g AS (SELECT * FROM (SELECT series, t, b AS b0, lag(b) OVER w AS b1, lag(t) OVER w AS t0, lead(b) OVER w AS xf, lead(t) OVER w AS t2 FROM b WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE t2 = t + 1 AND t0 = t - 1),
p AS (SELECT x.series AS target, y.series AS source, x.xf, x.b0 * 10 + x.b1 AS xp, y.b0 * 10 + y.b1 AS yp FROM g x JOIN g y USING (t) WHERE x.series <> y.series), {te_sql('p', 'target, source')} SELECT target, source, n_obs, {r6('te')} FROM te""")
def te_long_history(spark, sf_dir):
    return rounded(transfer.long_history(_binned(spark, sf_dir), 2, 2))


@query(f"""WITH {BINNED}, x AS (SELECT series, t, past, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i FROM e),
mixed AS (SELECT series, rep, past, row_number() OVER (PARTITION BY series, rep ORDER BY {drawn('series', 'rep', 'i')}, i) - 1 AS i FROM x, range(1, 10) AS r(rep)),
y AS (SELECT series AS source, 0 AS rep, t, past AS yp FROM e UNION ALL SELECT mixed.series, mixed.rep, x.t, mixed.past FROM mixed JOIN x USING (series, i)),
p AS (SELECT x.series AS target, y.source, y.rep, x.future AS xf, x.past AS xp, y.yp FROM e x JOIN y USING (t) WHERE x.series <> y.source), {te_sql('p', 'target, source, rep')},
o AS (SELECT target, source, te AS own FROM te WHERE rep = 0), others AS (SELECT target, source, avg(te) AS bias, stddev_samp(te) AS sd FROM te WHERE rep > 0 GROUP BY 1, 2)
SELECT target, source, {r6('own AS te', 'bias', 'own - bias AS effective', '(own - bias) / nullif(sd, 0) AS z')} FROM o JOIN others USING (target, source)""")
def te_effective(spark, sf_dir):
    return rounded(transfer.effective(_binned(spark, sf_dir), 9))


@query(f"""WITH {TE_HOURLY}, w AS (SELECT avg(te) + 0.5 * stddev_samp(te) AS cut, count(*) AS pairs FROM te), linked AS (SELECT source, target, te, pairs FROM te, w WHERE te > cut)
SELECT source, target, {r6('te', 'count(*) OVER () / pairs AS density')} FROM linked""")
def te_network(spark, sf_dir):
    e = information.embedded(_binned(spark, sf_dir, 8), "series", "t", "b")
    return rounded(transfer.network(information.transfer_entropy_pairs(e, "series", "t")))


@query(f"""WITH {BINNED}, p AS (SELECT a.series, k AS lag, a.b, c.b AS later FROM b a, range(1, 9) AS r(k), b c WHERE c.series = a.series AND c.t = a.t + k), n AS (SELECT series, lag, b, later, count(*) AS n FROM p GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY series, lag) AS t, sum(n) OVER (PARTITION BY series, lag, b) AS nx, sum(n) OVER (PARTITION BY series, lag, later) AS ny FROM n),
mi AS (SELECT series, lag::INT AS lag, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi FROM q GROUP BY 1, 2),
d AS (SELECT *, round(mi, 12) <= lag(round(mi, 12)) OVER w AND round(mi, 12) <= lead(round(mi, 12)) OVER w AS dip FROM mi WINDOW w AS (PARTITION BY series ORDER BY lag))
SELECT series, lag, {r6('mi')}, min(CASE WHEN dip THEN lag END) OVER (PARTITION BY series) AS first_minimum FROM d""")
def self_information(spark, sf_dir):
    return rounded(transfer.self_information(_binned(spark, sf_dir), 8))


def _code(v: str) -> str:
    a, b, c = (f"{v}{i}" for i in range(3))
    return f"((({b} < {a})::INT + ({c} < {a})::INT) * 9 + (({a} <= {b})::INT + ({c} < {b})::INT) * 3 + ({a} <= {c})::INT + ({b} <= {c})::INT)"


@query(f"""WITH {HOURLY}, g AS (SELECT k::INT AS scale, series, t // k AS t, avg(v) AS v FROM s, range(1, 4) AS r(k) GROUP BY 1, 2, 3),
o AS (SELECT scale, series, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM g WINDOW w AS (PARTITION BY scale, series ORDER BY t)), c AS (SELECT scale, series, {_code('v')} AS b, count(*) AS n FROM o WHERE v2 IS NOT NULL GROUP BY ALL),
p AS (SELECT scale, series, n / sum(n) OVER (PARTITION BY scale, series) AS p FROM c) SELECT scale, series, {r6('-sum(p * ln(p)) AS h', '-sum(p * ln(p)) / ln(6) AS normalized')} FROM p GROUP BY 1, 2""")
def multiscale_permutation_entropy(spark, sf_dir):
    return rounded(transfer.multiscale_permutation_entropy(summed(spark, sf_dir), 3))


@query(f"""WITH {HOURLY}, o AS (SELECT series, t, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)), b AS (SELECT series, t, {_code('v')} AS b FROM o WHERE v2 IS NOT NULL), {EMBED},
c AS (SELECT series, past AS b, future AS next, count(*) AS n FROM e GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY series, b) AS p FROM c)
SELECT series, b, next, n, {r6('p', '-sum(n * ln(p)) OVER (PARTITION BY series) / sum(n) OVER (PARTITION BY series) AS h')} FROM q""")
def pattern_transitions(spark, sf_dir):
    from infocausal.plans.catalogue import _patterns

    return rounded(transfer.pattern_transitions(_patterns(spark, sf_dir)))


# ---------------------------------------------------------------- matching on several covariates

MATCH = """WITH d AS (SELECT (c_mktsegment = 'BUILDING')::INT AS t, c_acctbal AS x, (c_custkey % 97)::DOUBLE AS u, c_nationkey::DOUBLE AS y, c_custkey AS k FROM customer),
z AS (SELECT t, y, k, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS a, (u - avg(u) OVER ()) / stddev_samp(u) OVER () AS b FROM d),
p AS (SELECT i.k, i.y, j.k AS match, j.y AS y_match, sqrt((i.a - j.a) ** 2 + (i.b - j.b) ** 2) AS distance FROM z i JOIN z j ON i.t = 1 AND j.t = 0 AND abs(i.a - j.a) <= 0.1 AND abs(i.b - j.b) <= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(distance, 12), match) AS q FROM p WHERE distance <= 0.1)"""


@query(f"{MATCH} SELECT {r6('avg(y - y_match) AS att', 'stddev_samp(y - y_match) / sqrt(count(*)) AS se')}, count(*) AS n FROM r WHERE q = 1")
def caliper_match_att(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("t"), F.col("c_acctbal").alias("x"),
                                                (F.col("c_custkey") % 97).cast("double").alias("u"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_custkey").alias("k"))
    return rounded(communities.matched_effect(communities.caliper_match(c, ["x", "u"], "k", 0.1)))


# ---------------------------------------------------------------- nearest neighbours

PSI = "h AS (SELECT k::INT AS k, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / j), 0) AS psi FROM range(1, 400) AS k(k) LEFT JOIN range(1, 400) AS j(j) ON j.j < k.k GROUP BY 1)"


@query(f"""WITH {DAILY}, {PSI}, d AS (SELECT i.series, i.t, abs(i.v - j.v) AS d, row_number() OVER (PARTITION BY i.series, i.t ORDER BY abs(i.v - j.v)) AS k FROM s i JOIN s j ON i.series = j.series AND i.t <> j.t),
n AS (SELECT series, count(*) AS n FROM s GROUP BY 1), a AS (SELECT series, avg(ln(d)) AS a FROM d WHERE k = 3 AND d > 0 GROUP BY 1)
SELECT series, n, {r6('CASE WHEN n > 3 THEN hn.psi - h3.psi + ln(2) + a END AS h')} FROM n LEFT JOIN a USING (series) JOIN h h3 ON h3.k = 3 JOIN h hn ON hn.k = n""")
def knn_entropy(spark, sf_dir):
    return rounded(kernels.knn_entropy(summed(spark, sf_dir, 86400)))


@query(f"""WITH {DAILY}, {PSI}, e AS (SELECT * FROM (SELECT series, t, v AS past, lead(v) OVER w AS nxt, lead(t) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE t2 = t + 1),
p AS (SELECT x.series AS target, y.series AS source, x.t, x.nxt AS a, y.past AS b, x.past AS c FROM e x JOIN e y USING (t) WHERE x.series <> y.series),
z AS (SELECT target, source, t, count(*) OVER w AS n, (a - avg(a) OVER w) / coalesce(nullif(stddev_samp(a) OVER w, 0), 1) AS a, (b - avg(b) OVER w) / coalesce(nullif(stddev_samp(b) OVER w, 0), 1) AS b,
  (c - avg(c) OVER w) / coalesce(nullif(stddev_samp(c) OVER w, 0), 1) AS c FROM p WINDOW w AS (PARTITION BY target, source)),
d AS (SELECT i.target, i.source, i.t, i.n, abs(i.a - j.a) AS da, abs(i.b - j.b) AS db, abs(i.c - j.c) AS dc, row_number() OVER (PARTITION BY i.target, i.source, i.t ORDER BY greatest(abs(i.a - j.a), abs(i.b - j.b), abs(i.c - j.c))) AS k
  FROM z i JOIN z j ON i.target = j.target AND i.source = j.source AND i.t <> j.t), q AS (SELECT target, source, t, greatest(da, db, dc) AS eps FROM d WHERE k = 3),
m AS (SELECT target, source, t, any_value(n) AS n, 1 + sum((greatest(da, dc) < eps)::INT)::INT AS na, 1 + sum((greatest(db, dc) < eps)::INT)::INT AS nb, 1 + sum((dc < eps)::INT)::INT AS nc FROM d JOIN q USING (target, source, t) GROUP BY 1, 2, 3)
SELECT target, source, any_value(n) AS n, {r6('greatest(-0.5772156649015329 + 1.5 - avg(ha.psi + hb.psi - hc.psi), 0) AS te')} FROM m JOIN h ha ON ha.k = na JOIN h hb ON hb.k = nb JOIN h hc ON hc.k = nc GROUP BY 1, 2""")
def knn_transfer(spark, sf_dir):
    return rounded(kernels.knn_transfer(summed(spark, sf_dir, 86400)))


# ---------------------------------------------------------------- interventions on discrete tables


@query("""WITH d AS (SELECT o_orderpriority AS z, (l_discount >= 0.05)::INT AS t, l_linestatus AS m, (l_quantity >= 25)::INT AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pz AS (SELECT z, count(*) / sum(count(*)) OVER () AS p FROM d GROUP BY z), pm AS (SELECT m, count(*) / sum(count(*)) OVER () AS p FROM d WHERE t = 1 GROUP BY m),
py AS (SELECT z, m, y, count(*) / sum(count(*)) OVER (PARTITION BY z, m) AS p FROM d GROUP BY z, m, y)
SELECT y, """ + r6("sum(pz.p * pm.p * py.p) AS p") + " FROM py JOIN pz USING (z) JOIN pm USING (m) GROUP BY y")
def truncated_factorization(spark, sf_dir):
    """z -> t -> m -> y <- z, with t set to 1."""
    li = table(spark, sf_dir, LI)
    d = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("z"), (F.col("l_discount") >= 0.05).cast("int").alias("t"), F.col("l_linestatus").alias("m"), (F.col("l_quantity") >= 25).cast("int").alias("y"))
    return rounded(interventions.truncated_factorization(d, {"z": [], "t": ["z"], "m": ["t"], "y": ["m", "z"]}, {"t": 1}, "y"))


@query(f"""WITH {T_SQL}, a AS (SELECT * FROM d WHERE ls = 'O'), b AS (SELECT * FROM d WHERE ls = 'F'), c AS (SELECT z, t, avg(y) AS m FROM a GROUP BY 1, 2), k AS (SELECT z FROM c GROUP BY z HAVING count(*) = 2),
h AS (SELECT z, count(*) AS n FROM a JOIN k USING (z) GROUP BY z), g AS (SELECT z, count(*) AS n FROM b JOIN k USING (z) GROUP BY z),
x AS (SELECT t, sum(m * n) / sum(n) AS ys FROM c JOIN h USING (z) GROUP BY t), y AS (SELECT t, sum(m * n) / sum(n) AS yt, sum(n) AS n FROM c JOIN g USING (z) GROUP BY t)
SELECT t, {r6('ys AS y_source', 'yt AS y_target', 'n / (SELECT count(*) FROM b) AS covered')} FROM x JOIN y USING (t)""")
def transported_effect(spark, sf_dir):
    d = treated(spark, sf_dir)
    return rounded(interventions.transported(d.filter("ls = 'O'"), d.filter("ls = 'F'")))


@query(f"""WITH {T_SQL}, c AS (SELECT z, count(*) AS n, sum((ls = 'O')::INT) AS k, avg(y) FILTER (ls = 'O') AS m FROM d GROUP BY z)
SELECT {r6('sum(m * k) / sum(k) AS seen', 'sum(m * n) / sum(n) AS corrected', 'sum(k) / sum(n) AS share')} FROM c WHERE k > 0""")
def selection_weighted(spark, sf_dir):
    return rounded(interventions.selection_weighted(treated(spark, sf_dir).select("z", (F.col("ls") == "O").cast("int").alias("s"), "y")))


@query(f"""WITH {T_SQL}, w AS (SELECT avg(yb) FILTER (t = 1) AS r1, avg(yb) FILTER (t = 0) AS r0 FROM d), c AS (SELECT z, count(*) AS n, avg(yb) FILTER (t = 1) - avg(yb) FILTER (t = 0) AS gap FROM d GROUP BY z),
i AS (SELECT sum(n * gap) / sum(n) AS c FROM c WHERE gap IS NOT NULL) SELECT {r6('r1 - r0 AS parity', 'c AS conditional', 'r1 - r0 - c AS explained', 'r1 / r0 AS impact')} FROM w, i""")
def fairness_gap(spark, sf_dir):
    return rounded(interventions.fairness(treated(spark, sf_dir, (F.col("l_returnflag") == "R").cast("int")), "t", "y", "z"))


@query(f"""WITH {T_SQL}, i AS (SELECT ls, count(*) AS n, corr(q, tax) AS r FROM d GROUP BY ls) SELECT {r6('(SELECT corr(q, tax) FROM d) AS marginal', 'sum(n * r) / sum(n) AS conditional')} FROM i""")
def collider_check(spark, sf_dir):
    return rounded(interventions.collider_check(treated(spark, sf_dir), "q", "tax", "ls"))
