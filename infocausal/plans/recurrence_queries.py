"""Neighbours in delay space, with SQL by full joins of pairs. Registered with those of catalogue.py."""

from __future__ import annotations

from infocausal.operators import recurrence
from infocausal.plans.catalogue import HOURLY, query, r6, rounded, summed

DIMS = (1, 2, 3)


def _scan_sql(m: int) -> str:
    """The nearest other vector of m delays, the earliest of equals."""
    shifted = " ".join(f"JOIN s s{k} ON s{k}.series = s.series AND s{k}.t = s.t - {k}" for k in range(1, m + 1))
    d = "greatest(" + ", ".join(f"abs(a.x{k} - b.x{k})" for k in range(m)) + ")" if m > 1 else "abs(a.x0 - b.x0)"
    return f"""p{m} AS (SELECT s.series, s.t, s.v AS x0, {', '.join(f's{k}.v AS x{k}' for k in range(1, m + 1))}, n.v AS next FROM s {shifted} JOIN s n ON n.series = s.series AND n.t = s.t + 1),
n{m} AS (SELECT a.series, a.t, abs(a.x{m} - b.x{m}) AS apart, a.next - b.next AS miss, {d} AS d FROM p{m} a JOIN p{m} b ON a.series = b.series AND a.t <> b.t
  QUALIFY row_number() OVER (PARTITION BY a.series, a.t ORDER BY {d}, b.t) = 1)"""


SCAN = f"WITH {HOURLY}, {', '.join(_scan_sql(m) for m in DIMS)}"


@query(f"{SCAN} " + " UNION ALL ".join(f"SELECT series, {m} AS m, count(*) AS n, {r6('avg((apart > 10 * d)::INT) AS false_share', 'sqrt(avg(miss * miss)) AS error')} FROM n{m} GROUP BY series" for m in DIMS))
def embedding_scan(spark, sf_dir):
    return rounded(recurrence.embedding_scan(summed(spark, sf_dir), DIMS))


@query(f"""WITH {HOURLY}, g AS (SELECT series, 0.7 * stddev_samp(v) AS r FROM s GROUP BY series),
p AS (SELECT a.series, a.t, a.v AS x0, b.v AS x1 FROM s a JOIN s b ON a.series = b.series AND b.t = a.t + 1),
q AS (SELECT a.series, a.t, count(*) AS d, sum((abs(a.x1 - b.x1) <= r)::INT) AS a FROM p a JOIN p b ON a.series = b.series AND a.t <> b.t JOIN g ON g.series = a.series WHERE abs(a.x0 - b.x0) <= r GROUP BY 1, 2),
n AS (SELECT series, count(*)::DOUBLE AS n FROM p GROUP BY series),
c AS (SELECT series, any_value(n) AS n, sum(d) / any_value(n) / (any_value(n) - 1) AS c1, sum(a) / any_value(n) / (any_value(n) - 1) AS cm, sum(d * (d - 1)) / any_value(n) / (any_value(n) - 1) / (any_value(n) - 2) AS k FROM q JOIN n USING (series) GROUP BY series)
SELECT series, n::BIGINT AS n, {r6('c1', 'cm', 'sqrt(n) * (cm - c1 * c1) / sqrt(4 * (k * k + 2 * k * c1 ** 2 + c1 ** 4 - 4 * k * c1 ** 2)) AS statistic')} FROM c""")
def serial_dependence(spark, sf_dir):
    return rounded(recurrence.serial_dependence(summed(spark, sf_dir)))


@query(f"""WITH {HOURLY}, z AS (SELECT series, t, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM s WINDOW w AS (PARTITION BY series)),
e AS (SELECT a.series, a.t, a.v AS past, b.v AS next FROM z a JOIN z b ON a.series = b.series AND b.t = a.t + 1),
p AS (SELECT a.series AS target, a.t, b.t AS t2, abs(a.next - b.next) <= 0.5 AS f FROM e a JOIN e b ON a.series = b.series AND abs(a.t - b.t) > 1 AND abs(a.past - b.past) <= 0.5),
c AS (SELECT target, y.series AS source, p.t, count(*) AS p, sum(f::INT) AS fp, sum((abs(y.v - y2.v) <= 0.5)::INT) AS py, sum((f AND abs(y.v - y2.v) <= 0.5)::INT) AS fpy
  FROM p JOIN z y ON y.t = p.t AND y.series <> target JOIN z y2 ON y2.t = p.t2 AND y2.series = y.series GROUP BY 1, 2, 3)
SELECT target, source, count(*) AS n, {r6('avg(ln(fpy * p / (py * fp))) AS te')} FROM c WHERE fpy > 0 GROUP BY 1, 2""")
def correlation_transfer(spark, sf_dir):
    return rounded(recurrence.correlation_transfer(summed(spark, sf_dir)))
