"""Distributions after interventions from observed discrete tables: everything starts from counts by joint state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.operators.network import topological
from infocausal.scratch import materialize


def truncated_factorization(df: DataFrame, parents: dict[str, list[str]], do: dict, outcome: str) -> DataFrame:
    """outcome, p: P(outcome | do(..)) as the product of P(v | parents) over all variables that aren't set, in causal order.

    Each factor is a table of counts; after a factor is joined, variables that no later one needs are summed
    out, so the running table has the states of the open variables only.
    """
    edges = [(a, v) for v, ps in parents.items() for a in ps]
    order = topological(edges) if edges else []
    if order is None:
        raise ValueError("the graph has a cycle")
    order = [v for v in [*order, *[v for v in parents if v not in order]] if v not in do]
    names = sorted({*parents, *do, *[a for a, _ in edges]})
    counts = materialize(df.select(*names).na.drop().groupBy(*names).agg(F.count("*").alias("_n")), "counts")
    state: DataFrame | None = None
    for i, v in enumerate(order):
        ps = parents.get(v, [])
        free = [a for a in ps if a not in do]
        own = counts
        for a in ps:
            if a in do:
                own = own.filter(F.col(a) == F.lit(do[a]))
        factor = own.groupBy(v, *free).agg(F.sum("_n").alias("_n"))
        factor = factor.select(v, *free, (F.col("_n") / F.sum("_n").over(Window.partitionBy(*free))).alias("_f"))
        if state is None:
            state = factor.withColumnRenamed("_f", "p")
        else:
            joined = state.join(factor, free) if free else state.crossJoin(F.broadcast(factor))  # states of one variable
            state = joined.withColumn("p", F.col("p") * F.col("_f")).drop("_f")
        needed = {outcome, *[a for w in order[i + 1 :] for a in parents.get(w, [])]}
        keep = [c for c in state.columns if c != "p" and c in needed]
        state = state.groupBy(*keep).agg(F.sum("p").alias("p"))
    return state.groupBy(outcome).agg(F.sum("p").alias("p"))


def transported(source: DataFrame, target: DataFrame) -> DataFrame:
    """t, y_source, y_target: E[y | do(t)] in the population of source (t, y, z) and in that of target (z), where z is all that differs and is enough to adjust for.

    covered: the share of target rows whose z has both arms in source; the others are left out of the means.
    """
    cells = source.groupBy("z", "t").agg(F.avg("y").alias("m"))
    both = cells.groupBy("z").agg(F.count("*").alias("arms")).filter("arms = 2").select("z")
    here, there = (d.groupBy("z").agg(F.count("*").alias("n")).join(both, "z") for d in (source, target))
    all_rows = target.agg(F.count("*").alias("all"))
    mean = lambda w: cells.join(w, "z").groupBy("t").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("k"))
    a, b = mean(here).select("t", F.col("y").alias("y_source")), mean(there).select("t", F.col("y").alias("y_target"), "k")
    return a.join(b, "t").crossJoin(F.broadcast(all_rows)).select("t", "y_source", "y_target", (F.col("k") / F.col("all")).alias("covered"))


def selection_weighted(df: DataFrame) -> DataFrame:
    """seen, corrected: the mean of y over selected rows, and over all with weights 1 / P(selected | z); columns z, s (0 or 1) and y (known where s is 1)."""
    c = df.groupBy("z").agg(F.count("*").alias("n"), F.sum(F.col("s").cast("int")).alias("k"), F.avg(F.when(F.col("s") == 1, F.col("y"))).alias("m")).filter("k > 0")
    return c.agg((F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("seen"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("corrected"), (F.sum("k") / F.sum("n")).alias("share"))


def inverse_mills(z: Column, terms: int = 60) -> Column:
    """phi(z) / Phi(z): the mean of a standard normal that is over -z. Phi by the series z + z^3/3 + z^5/15 + .. for |z| up to 6."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series, term = z, z
    for i in range(1, terms):
        term = term * z * z / (2 * i + 1)
        series = series + term
    return F.when(F.abs(z) <= 6, density / (0.5 + density * series)).when(z > 6, density)


def fairness(df: DataFrame, group: str, decision: str, given: str) -> DataFrame:
    """parity (difference of the groups' decision rates), conditional (the same within `given`, weighted by its rows), explained (the rest), impact (ratio of rates)."""
    g, d = F.col(group).cast("int"), F.col(decision).cast("double")
    rate = lambda k: F.avg(F.when(g == k, d))
    whole = df.agg(rate(1).alias("r1"), rate(0).alias("r0"))
    cells = df.groupBy(F.col(given).alias("z")).agg(F.count("*").alias("n"), (rate(1) - rate(0)).alias("gap")).filter("gap is not null")
    inner = cells.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("conditional"))
    parity = F.col("r1") - F.col("r0")
    return whole.crossJoin(inner).select(parity.alias("parity"), "conditional", (parity - F.col("conditional")).alias("explained"), (F.col("r1") / F.col("r0")).alias("impact"))  # one row each


def collider_check(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """marginal, conditional: correlation of two columns over all rows, and inside the strata of a third, weighted by rows. A gap that opens with c speaks for selection on a common effect."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    inner = df.groupBy(c).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).filter("r is not null and not isnan(r)")
    whole = df.agg(F.corr(x, y).alias("marginal"))
    return whole.crossJoin(inner.agg((F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("conditional")))  # one row each
