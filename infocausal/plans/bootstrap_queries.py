"""Bootstrap errors of effects, with the same draws in SQL. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from infocausal.operators import rowboot
from infocausal.plans.catalogue import LI, T_SQL, query, r6, rounded, table, treated

REPS = 40
_U = "('0x' || substr(md5(k || '|' || (rep // 4)), (rep % 4) * 8 + 1, 8))::BIGINT / 4294967296.0"


def _intervals_sql(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS estimator, {r6(f'(SELECT {n} FROM own) AS estimate', f'stddev_samp({n}) AS se', f'quantile_cont({n}, 0.025) AS low', f'quantile_cont({n}, 0.975) AS high')}, count({n}) AS replicates FROM reps" for n in names)


def _estimates_sql(src: str, by: str) -> str:
    """From (by, z, n0, n1, s0, s1)."""
    both = "n0 > 0 AND n1 > 0"
    return f"""SELECT {by}sum(s1) / sum(n1) - sum(s0) / sum(n0) AS naive,
  sum((n0 + n1) * (s1 / n1 - s0 / n0)) FILTER ({both}) / sum(n0 + n1) FILTER ({both}) AS stratified,
  sum(s1 * (n0 + n1) / n1) FILTER ({both}) / sum(n0 + n1) FILTER ({both}) - sum(s0 * (n0 + n1) / n0) FILTER ({both}) / sum(n0 + n1) FILTER ({both}) AS weighted,
  sum(s1 - n1 * s0 / n0) FILTER ({both}) / sum(n1) FILTER ({both}) AS treated FROM {src} {'GROUP BY rep' if by else ''}"""


def _arms(w: str) -> str:
    return ", ".join(f"coalesce(sum({w}{' * y' if v == 's' else ''}) FILTER (t = {t}), 0) AS {v}{t}" for v in "ns" for t in (0, 1))


@query(f"""WITH {T_SQL}, x AS (SELECT z, t, y::DOUBLE AS y, concat_ws('|', ok, ln, q) AS k FROM d),
w AS (SELECT rep, z, t, y, {rowboot.weight_sql(_U)} AS w FROM x, range(0, {REPS}) AS r(rep)),
a AS (SELECT rep, z, {_arms('w')} FROM w GROUP BY rep, z), b AS (SELECT z, {_arms('1')} FROM x GROUP BY z),
reps AS ({_estimates_sql('a', 'rep, ')}), own AS ({_estimates_sql('b', '')}) {_intervals_sql(list(rowboot.ESTIMATORS))}""")
def bootstrap_effects(spark, sf_dir):
    return rounded(rowboot.effect_errors(treated(spark, sf_dir), ["ok", "ln", "q"], REPS))


def _moments(w: str) -> str:
    pairs = [(a, b) for i, a in enumerate("tmy") for b in "tmy"[i:]]
    return ", ".join(f"sum({w} * {a} * {b}) / sum({w}) - sum({w} * {a}) / sum({w}) * (sum({w} * {b}) / sum({w})) AS {a}{b}" for a, b in pairs)


_MED = "(mm * ty - tm * my) / (tt * mm - tm * tm) AS direct, tm / tt * (tt * my - tm * ty) / (tt * mm - tm * tm) AS indirect, ty / tt AS total"


@query(f"""WITH x AS (SELECT (l_discount >= 0.05)::INT::DOUBLE AS t, l_quantity AS m, ln(l_extendedprice) AS y, concat_ws('|', l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem),
w AS (SELECT rep, t, m, y, {rowboot.weight_sql(_U)} AS w FROM x, range(0, {REPS}) AS r(rep)),
reps AS (SELECT {_MED} FROM (SELECT rep, {_moments('w')} FROM w GROUP BY rep)), own AS (SELECT {_MED} FROM (SELECT {_moments('1')} FROM x)) {_intervals_sql(['direct', 'indirect', 'total'])}""")
def bootstrap_mediation(spark, sf_dir):
    """Of discount on the log price, through the quantity."""
    d = table(spark, sf_dir, LI).select(
        (F.col("l_discount") >= 0.05).cast("int").alias("t"), F.col("l_quantity").alias("m"), F.log("l_extendedprice").alias("y"), "l_orderkey", "l_linenumber", "l_suppkey")
    return rounded(rowboot.moment_errors(d, ["t", "m", "y"], ["l_orderkey", "l_linenumber", "l_suppkey"], rowboot.mediated, REPS))
