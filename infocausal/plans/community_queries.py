"""The map equation over customers and suppliers. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from infocausal.operators import mapequation
from infocausal.plans.catalogue import FAR, LI, query, r6, table
from infocausal.scratch import tasks_for

#: A customer and the suppliers of its orders, by lines; suppliers are told apart by an offset.
SUPPLY = f"e AS (SELECT o_custkey AS src, l_suppkey + {FAR} AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def supply(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    li = table(spark, sf_dir, LI).select("l_orderkey", (F.col("l_suppkey") + F.lit(FAR)).alias("dst"))
    n = tasks_for(spark, li.count())
    j = li.repartition(n, "l_orderkey").join(o.repartition(n, "l_orderkey"), "l_orderkey")
    return j.select("src", "dst").repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


_PL = lambda x: f"CASE WHEN {x} > 1e-15 THEN {x} * ln({x}) ELSE 0 END"


@query(f"""WITH {SUPPLY}, f AS (SELECT src, dst, w / (2 * (SELECT sum(w) FROM e)) AS f FROM e UNION ALL SELECT dst, src, w / (2 * (SELECT sum(w) FROM e)) FROM e),
k AS (SELECT c_custkey AS node, c_nationkey AS module FROM customer UNION ALL SELECT s_suppkey + {FAR}, s_nationkey FROM supplier),
v AS (SELECT dst AS node, sum(f) AS p FROM f GROUP BY dst), m AS (SELECT module, sum(p) AS p FROM v JOIN k USING (node) GROUP BY module),
x AS (SELECT a.module AS m1, b.module AS m2, f FROM f JOIN k a ON a.node = src JOIN k b ON b.node = dst WHERE a.module <> b.module),
o AS (SELECT m.module, m.p, coalesce((SELECT sum(f) FROM x WHERE m2 = m.module), 0) AS e, coalesce((SELECT sum(f) FROM x WHERE m1 = m.module), 0) AS x FROM m),
t AS (SELECT sum(e) AS e, sum({_PL('e')}) AS le, sum({_PL('x')}) AS lx, sum({_PL('(x + p)')}) AS lxp FROM o), n AS (SELECT sum({_PL('p')}) AS lp FROM v)
SELECT {r6(f'{_PL("e")} - le - lx + lxp - lp AS nation', '-lp AS whole')} FROM t, n""")
def map_equation(spark, sf_dir):
    """Nats a step with nations as modules, and with all nodes in one."""
    flow = mapequation.link_flow(supply(spark, sf_dir))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("module"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + F.lit(FAR)).alias("node"), F.col("s_nationkey").cast("long").alias("module"))
    nations = mapequation.code_length(flow, c.unionByName(s))
    whole = mapequation.code_length(flow, mapequation.visits(flow).select("node", F.lit(0).cast("long").alias("module")))
    return spark.createDataFrame([(round(nations, 6), round(whole, 6))], "nation double, whole double")


@query()
def infomap_supply(spark, sf_dir):
    """Modules of customers and suppliers, by moves until none is left that shortens the code. Rounds of moves are beyond SQL; the tests hold the length against its formula and the modules against planted ones."""
    return mapequation.infomap(supply(spark, sf_dir))
