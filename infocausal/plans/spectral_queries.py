"""Spectra and densities with equal SQL. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from infocausal.operators import spectral
from infocausal.plans.catalogue import DAILY, HOURLY, LI, query, r6, rounded, summed, table

LENGTH, KINDS = 48, ("hann", "hamming", "blackman")


def _taper(kind: str) -> str:
    a, b, c = spectral.TAPERS[kind]
    return f"{a}::DOUBLE + {b}::DOUBLE * cos(2 * pi() * i / {LENGTH - 1}) + {c}::DOUBLE * cos(4 * pi() * i / {LENGTH - 1})"


@query(f"""WITH {HOURLY}, m AS (SELECT series, min(t) AS lo, max(t) AS hi FROM s GROUP BY series),
g AS (SELECT series, lo, k AS segment FROM m, range(0, 100000) AS r(k) WHERE lo + k * {LENGTH // 2} + {LENGTH} - 1 <= hi),
x AS (SELECT g.series, g.segment, s.t - g.lo - g.segment * {LENGTH // 2} AS i, s.v FROM g JOIN s ON s.series = g.series AND s.t >= g.lo + g.segment * {LENGTH // 2} AND s.t < g.lo + g.segment * {LENGTH // 2} + {LENGTH}),
d AS (SELECT series, segment, i, v - avg(v) OVER (PARTITION BY series, segment) AS d FROM x),
w AS ({' UNION ALL '.join(f"SELECT '{k}' AS taper, series, segment, i, d * ({_taper(k)}) AS w FROM d" for k in KINDS)}),
f AS (SELECT taper, series, segment, k, sum(w * cos(2 * pi() * i * k / {LENGTH})) AS c, sum(w * sin(2 * pi() * i * k / {LENGTH})) AS s FROM w, range(0, {LENGTH // 2 + 1}) AS r(k) GROUP BY ALL),
n AS ({' UNION ALL '.join(f"SELECT '{k}' AS taper, sum(pow({_taper(k)}, 2)) AS u FROM range(0, {LENGTH}) AS r(i)" for k in KINDS)})
SELECT f.taper, series, k::INT AS k, k / {LENGTH} AS frequency, count(*) AS segments, {r6(f'avg((c * c + s * s) * CASE WHEN k = 0 OR 2 * k = {LENGTH} THEN 1 ELSE 2 END) / any_value(u) AS power')} FROM f JOIN n USING (taper) GROUP BY f.taper, series, k""".replace(f"k / {LENGTH} AS frequency", f"round(k / {LENGTH}, 6) + 0.0 AS frequency"))
def welch_spectrum(spark, sf_dir):
    """Segments of two days, a day apart, with three tapers."""
    return rounded(spectral.welch(summed(spark, sf_dir), LENGTH, kinds=KINDS))


def _grid_sql(src: str, cols: list[str], cells: int, by: str) -> str:
    """CTEs d0 (statistics) and c (by, g0.., w, n, h0, d0..)."""
    k = len(cols)
    stat = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}, 1.06 * stddev_samp({c}) * pow(count(*), {-1.0 / (4 + k)}) AS h{i}" for i, c in enumerate(cols))
    step = ", ".join(f"(hi{i} - lo{i} + 6 * h{i}) / {cells - 1} AS d{i}" for i in range(k))
    at = ", ".join(f"({c} - lo{i} + 3 * h{i}) / d{i} AS p{i}" for i, c in enumerate(cols))
    deal = ", ".join(f"floor(p{i})::BIGINT + o{i} AS g{i}" for i in range(k))
    weight = " * ".join(f"(CASE WHEN o{i} = 1 THEN p{i} - floor(p{i}) ELSE 1 - (p{i} - floor(p{i})) END)" for i in range(k))
    offsets = ", ".join(f"(VALUES (0), (1)) AS t{i}(o{i})" for i in range(k))
    hd = ", ".join(f"h{i}, d{i}" for i in range(k))
    return f"""q0 AS (SELECT {by}, count(*) AS n, {stat} FROM {src} GROUP BY {by}), q1 AS (SELECT *, {step} FROM q0),
q2 AS (SELECT {src}.{by}, n, {hd}, {at} FROM {src} JOIN q1 USING ({by})), q3 AS (SELECT {by}, n, {hd}, {deal}, {weight} AS w FROM q2, {offsets}),
c AS MATERIALIZED (SELECT {by}, {', '.join(f'g{i}' for i in range(k))}, sum(w) AS w, any_value(n) AS n, {', '.join(f'any_value(h{i}) AS h{i}, any_value(d{i}) AS d{i}' for i in range(k))} FROM q3 GROUP BY ALL HAVING sum(w) > 0)""".replace("GROUP BY ALL", f"GROUP BY {by}, {', '.join(f'g{i}' for i in range(k))}")


def _kernel(i: int) -> str:
    return f"exp(-0.5 * pow((x.g{i} - y.g{i}) * y.d{i} / y.h{i}, 2)) / (y.h{i} * sqrt(2 * pi()))"


@query(f"""WITH {DAILY}, {_grid_sql('s', ['v'], 128, 'series')},
f AS (SELECT x.series, x.g0, sum(y.w * {_kernel(0)}) / any_value(y.n) AS f FROM c x JOIN c y USING (series) GROUP BY 1, 2)
SELECT series, any_value(n) AS n, {r6('sum(-w / n * ln(f)) AS h')} FROM c JOIN f USING (series, g0) GROUP BY series""")
def kernel_entropy(spark, sf_dir):
    return rounded(spectral.kernel_entropy(summed(spark, sf_dir, 86400), "v"))


@query(f"""WITH l AS (SELECT l_returnflag AS flag, l_quantity AS a, ln(l_extendedprice / l_quantity) AS b FROM lineitem WHERE l_quantity > 0), {_grid_sql('l', ['a', 'b'], 24, 'flag')},
f0 AS (SELECT x.flag, x.g0, sum(y.w * {_kernel(0)}) / any_value(y.n) AS f0 FROM (SELECT DISTINCT flag, g0 FROM c) x JOIN c y USING (flag) GROUP BY 1, 2),
f1 AS (SELECT x.flag, x.g1, sum(y.w * {_kernel(1)}) / any_value(y.n) AS f1 FROM (SELECT DISTINCT flag, g1 FROM c) x JOIN c y USING (flag) GROUP BY 1, 2),
f AS (SELECT x.flag, x.g0, x.g1, sum(y.w * {_kernel(0)} * {_kernel(1)}) / any_value(y.n) AS f FROM c x JOIN c y USING (flag) GROUP BY 1, 2, 3)
SELECT flag, any_value(n) AS n, {r6('sum(w / n * ln(f / (f0 * f1))) AS mi')} FROM c JOIN f USING (flag, g0, g1) JOIN f0 USING (flag, g0) JOIN f1 USING (flag, g1) GROUP BY flag""")
def kernel_information(spark, sf_dir):
    """Of quantity and the log price of a unit, by return flag, over all lines."""
    li = table(spark, sf_dir, LI).filter("l_quantity > 0")
    d = li.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("a"), F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("b"))
    return rounded(spectral.kernel_information(d, "a", "b", 24, ["flag"]))
