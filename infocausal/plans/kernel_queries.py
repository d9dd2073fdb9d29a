"""Queries of the kernel tests on random features, with SQL over the same fixed features. Registered with those of catalogue.py."""

from __future__ import annotations

from infocausal.operators import features
from infocausal.operators.features import Cosines, KernelTest, moments_sql, sweep_sql
from infocausal.plans.catalogue import HOURLY, LI, NUMERIC, query, r6, rounded, summed, table
from pyspark.sql import functions as F

#: Few features, so that the SQL stays readable; the operator's own defaults are larger.
SMALL = KernelTest(d=4, d_given=4, replicates=60)
KEY = ["l_orderkey", "l_linenumber", "l_suppkey"]
#: q: quantity, e: price, u: price of a unit, d: discount, tax. u is a function of q and e; the others are drawn apart.
LINES = "l AS (SELECT l_quantity AS q, l_extendedprice AS e, l_extendedprice / l_quantity AS u, l_discount AS d, l_tax AS tax, concat_ws('|', l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem WHERE l_quantity > 0)"


def lines(spark, sf_dir):
    li = table(spark, sf_dir, LI).filter("l_quantity > 0")
    return li.select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("tax"), *KEY)


def _test_sql(tag: str, x: str, y: str, given: list[str], p: KernelTest) -> str:
    """CTEs that end in `tag`_r (one row: x, y, given, n, statistic, p_signs)."""
    fx, fy, fz = p.sides(len(given))
    names = list(dict.fromkeys([x, y, *given]))
    feats = [*fx.sql([x, *given]), *fy.sql([y]), *(fz.sql(given) if fz else [])]
    da, db, m = fx.d, fy.d, len(feats)
    dz = m - da - db
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in names)
    cols = [f"f{i}" for i in range(m)]
    final = f"{tag}_{dz}"
    sign = "('0x' || substr(md5(k || '|0'), 1, 15))::BIGINT"
    resid = lambda i: f"(f{i} - m[{i + 1}]" + "".join(f" - s[{i * m + c + 1}] * (f{c} - m[{c + 1}])" for c in range(da + db, m)) + ")"
    drawn = " + ".join(
        f"pow(sum(CASE WHEN (h >> b) & 1 = 1 THEN p[{i * db + j + 1}] ELSE -p[{i * db + j + 1}] END), 2)" for i in range(da) for j in range(db))
    products = ", ".join(f"r[{i + 1}] * r[{da + j + 1}] - s[{i * m + da + j + 1}]" for i in range(da) for j in range(db))
    return f"""{tag}_z AS (SELECT k, {z} FROM l), {tag}_f AS MATERIALIZED (SELECT k, {', '.join(f'{f} AS {c}' for f, c in zip(feats, cols, strict=True))} FROM {tag}_z),
{moments_sql(tag, tag + '_f', cols, range(da + db, m), p.ridge)}{',' if dz else ''}
{sweep_sql(tag, range(da + db, m))},
{tag}_s AS (SELECT list(v ORDER BY i, j) AS s FROM {final}),
{tag}_m AS (SELECT [{', '.join(f'avg({c})' for c in cols)}] AS m, count(*) AS n FROM {tag}_f),
{tag}_t AS (SELECT n, n * ({' + '.join(f'pow(s[{i * m + da + j + 1}], 2)' for i in range(da) for j in range(db))}) AS t FROM {tag}_s, {tag}_m),
{tag}_p AS (SELECT {sign} AS h, [{', '.join(resid(i) for i in range(da + db))}] AS r, s FROM {tag}_f, {tag}_m, {tag}_s),
{tag}_q AS (SELECT h, [{products}] AS p FROM {tag}_p),
{tag}_b AS (SELECT b, {drawn} AS t FROM {tag}_q, range({features.SIGNS}) AS w(b) GROUP BY b),
{tag}_r AS (SELECT '{x}' AS x, '{y}' AS y, '{','.join(given)}' AS given, any_value(a.n) AS n, any_value(a.t) AS statistic, (1 + sum((b.t / a.n >= a.t)::INT)) / {1 + features.SIGNS} AS p_signs FROM {tag}_b b, {tag}_t a)"""


TESTS = [("q", "u", ["e"]), ("q", "d", ["e"]), ("d", "tax", ["q"])]


@query(f"WITH {LINES}, {', '.join(_test_sql(f'a{i}', *t, SMALL) for i, t in enumerate(TESTS))} " + " UNION ALL ".join(f"SELECT x, y, given, n, {r6('statistic', 'p_signs')} FROM a{i}_r" for i in range(len(TESTS))))
def kernel_conditional_test(spark, sf_dir):
    """Quantity depends on the price of a unit given the price, and on nothing else here."""
    return rounded(features.kernel_tests(lines(spark, sf_dir), TESTS, KEY, SMALL).select("x", "y", "given", "n", "statistic", "p_signs"))


SHORT = {"l_quantity": "q", "l_extendedprice": "e", "l_discount": "d", "l_tax": "tax"}
NUMERIC_PAIRS = [(SHORT[a], SHORT[b]) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]] + [("e", "u")]


@query(f"WITH {LINES}, {', '.join(_test_sql(f'a{i}', *t, [], SMALL) for i, t in enumerate(NUMERIC_PAIRS))} " + " UNION ALL ".join(f"SELECT x, y, n, {r6('statistic', 'p_signs')} FROM a{i}_r" for i in range(len(NUMERIC_PAIRS))))
def kernel_dependence(spark, sf_dir):
    """All pairs of numbers of a line, over all lines."""
    return rounded(features.kernel_tests(lines(spark, sf_dir), [(x, y, []) for x, y in NUMERIC_PAIRS], KEY, SMALL).select("x", "y", "n", "statistic", "p_signs"))


DIRECTION_D = 4


def _direction_sql(tag: str, cause: str, effect: str) -> str:
    f = Cosines.drawn(1, DIRECTION_D, SMALL.seed + 7, SMALL.width)
    fx, fy, _ = SMALL.sides(0)
    d, cols = f.d, [f"f{i}" for i in range(f.d)] + ["y"]
    m = d + 1
    value = " + ".join(f"s[{d * m + i + 1}] * (f{i} - m[{i + 1}])" for i in range(d))
    both = [*fx.sql(["c"]), *fy.sql(["r"])]
    return f"""{tag}_z AS (SELECT ({cause} - avg({cause}) OVER ()) / stddev_pop({cause}) OVER () AS c, ({effect} - avg({effect}) OVER ()) / stddev_pop({effect}) OVER () AS y FROM l),
{tag}_f AS MATERIALIZED (SELECT c, y, {', '.join(f'{x} AS f{i}' for i, x in enumerate(f.sql(['c'])))} FROM {tag}_z),
{moments_sql(tag, tag + '_f', cols, range(d), 0.001)},
{sweep_sql(tag, range(d))},
{tag}_s AS (SELECT list(v ORDER BY i, j) AS s FROM {tag}_{d}), {tag}_m AS (SELECT [{', '.join(f'avg({c})' for c in cols)}] AS m, var_pop(y) AS yy FROM {tag}_f),
{tag}_e AS (SELECT c, y - (m[{m}] + {value}) AS r, 1 - s[{m * m}] / yy AS r2 FROM {tag}_f, {tag}_s, {tag}_m),
{tag}_n AS (SELECT r2, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS r FROM {tag}_e),
{tag}_g AS (SELECT r2, {', '.join(f'{x} AS g{i}' for i, x in enumerate(both))} FROM {tag}_n),
{tag}_r AS (SELECT '{cause}' AS cause, '{effect}' AS effect, count(*) AS n, any_value(r2) AS r2, count(*) * ({' + '.join(f'pow(covar_pop(g{i}, g{fx.d + j}), 2)' for i in range(fx.d) for j in range(fy.d))}) AS statistic FROM {tag}_g)"""


@query(f"WITH {LINES}, {_direction_sql('a', 'q', 'u')}, {_direction_sql('b', 'u', 'q')} " + " UNION ALL ".join(f"SELECT cause, effect, n, {r6('r2', 'statistic')} FROM {t}_r" for t in "ab"))
def noise_direction(spark, sf_dir):
    return rounded(features.noise_direction(lines(spark, sf_dir), "q", "u", DIRECTION_D, SMALL, 1e-3).drop("p"))


OWN, JOINT = Cosines.drawn(1, 3, 1), Cosines.drawn(2, 4, 2)
_K = OWN.d + JOINT.d
_NAMES = [f"f{i}" for i in range(_K)] + ["xf"]


@query(f"""WITH {HOURLY}, z AS (SELECT series, t, (v - avg(v) OVER (PARTITION BY series)) / coalesce(nullif(stddev_pop(v) OVER (PARTITION BY series), 0), 1) AS v FROM s),
o AS (SELECT * FROM (SELECT series, t, v AS past, lead(v) OVER w AS next, lead(t) OVER w AS t2 FROM z WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE t2 = t + 1),
f AS (SELECT x.series AS target, y.series AS source, {', '.join(f'{x} AS f{i}' for i, x in enumerate([*OWN.sql(['x.past']), *JOINT.sql(['x.past', 'y.past'])]))}, x.next AS xf FROM o x JOIN o y USING (t) WHERE x.series <> y.series),
{moments_sql('g', 'f', _NAMES, range(_K), 0.001, ['target', 'source'])},
{sweep_sql('g', range(_K), ['target', 'source'])},
n AS (SELECT target, source, count(*) AS n FROM f GROUP BY 1, 2)
SELECT target, source, n, {r6(f'CASE WHEN n > {_K + 1} THEN (a.v - b.v) / {JOINT.d} / (b.v / (n - {_K + 1})) END AS f_stat')}
FROM n JOIN g_{OWN.d} a USING (target, source) JOIN g_{_K} b USING (target, source) WHERE a.i = {_K} AND a.j = {_K} AND b.i = {_K} AND b.j = {_K}""")
def kernel_granger(spark, sf_dir):
    return rounded(features.kernel_granger(summed(spark, sf_dir), OWN, JOINT).drop("p"))
