"""Effects of treatments that are given step by step, with covariates that earlier steps change.

A unit has a row: covariates l1 .. lT, binary treatments a1 .. aT and the outcome y. Rows are
summed by history once; the backward steps run on that table of states, a smaller one each step.
Histories that nobody continued by the plan are left out and their share is reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.operators.dependence import Gram
from infocausal.operators.graph import d_separated
from infocausal.operators.identify import ancestors, cut


def units(df: DataFrame, unit: str, order: Sequence[str], values: dict[str, str | Column], steps: int, outcome: str | Column) -> DataFrame:
    """unit, <name>1 .. <name>T for each value, y (the outcome at step T + 1): the first rows of each unit in order, of units that have as many."""
    w = Window.partitionBy(unit).orderBy(*order)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    x = df.select(unit, *order, *[col(c).alias(f"_{n}") for n, c in values.items()], col(outcome).alias("_out")).withColumn("_t", F.row_number().over(w)).filter(F.col("_t") <= steps + 1)
    at = lambda c, t: F.max(F.when(F.col("_t") == t, F.col(c)))
    wide = x.groupBy(unit).agg(*[at(f"_{n}", t).alias(f"{n}{t}") for t in range(1, steps + 1) for n in values], at("_out", steps + 1).alias("y"), F.count("*").alias("_k"))
    return wide.filter(F.col("_k") == steps + 1).drop("_k")


def _states(df: DataFrame, steps: int) -> DataFrame:
    keys = [f"{n}{t}" for t in range(1, steps + 1) for n in ("l", "a")]
    return df.na.drop(subset=[*keys, "y"]).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def plan_mean(df: DataFrame, plan: Sequence[int]) -> DataFrame:
    """mean, covered, followers: the outcome's mean had every unit been treated by the plan, by iterated conditional expectations.

    The last step's value of a covariate history is the mean outcome of its followers. A step back,
    the values are averaged over the next covariate as it came among those who followed so far.
    """
    steps = len(plan)
    states = _states(df, steps)
    follows = lambda t: [F.col(f"a{k}") == plan[k - 1] for k in range(1, t + 1)]
    both = lambda cs: F.lit(True) if not cs else cs[0] if len(cs) == 1 else cs[0] & both(cs[1:])
    history = lambda t: [f"l{k}" for k in range(1, t + 1)]
    value = states.filter(both(follows(steps))).groupBy(*history(steps)).agg((F.sum("s") / F.sum("n")).alias("q"), F.lit(1.0).alias("c"), F.sum("n").alias("f"))
    for t in range(steps, 0, -1):
        came = states.filter(both(follows(t - 1))).groupBy(*history(t)).agg(F.sum("n").alias("n"))
        j = came.join(value, history(t), "left")
        # Means over the covered part; c is the covered share.
        weight = F.col("n") * F.coalesce(F.col("c"), F.lit(0.0))
        sums = [F.sum(weight * F.col("q")) / F.nullif(F.sum(weight), F.lit(0.0)), F.sum(weight) / F.sum("n"), F.coalesce(F.sum("f"), F.lit(0))]
        value = j.groupBy(*history(t - 1)).agg(*[c.alias(n) for c, n in zip(sums, ("q", "c", "f"), strict=True)])
    return value.select(F.col("q").alias("mean"), F.col("c").alias("covered"), F.col("f").alias("followers"))


def plan_weighted(df: DataFrame, plan: Sequence[int]) -> DataFrame:
    """mean, followers, effective_n: the same mean by weights, the inverse of the chance at each step to go on by the plan given the history."""
    steps = len(plan)
    s = _states(df, steps)
    weight = F.lit(1.0)
    for t in range(1, steps + 1):
        before = [f"{n}{k}" for k in range(1, t) for n in ("l", "a")] + [f"l{t}"]
        weight = weight * F.sum("n").over(Window.partitionBy(*before)) / F.sum("n").over(Window.partitionBy(*before, f"a{t}"))
    x = s.withColumn("w", weight).filter(" and ".join(f"a{t} = {a}" for t, a in enumerate(plan, 1)))
    n, w = F.col("n"), F.col("w")
    return x.agg((F.sum(w * F.col("s")) / F.sum(w * n)).alias("mean"), F.sum("n").alias("followers"), (F.sum(w * n) * F.sum(w * n) / F.sum(w * w * n)).alias("effective_n"))


def sequential_g(spark: SparkSession, df: DataFrame, t: str, mediator: str, y: str, between: Sequence[str] = (), before: Sequence[str] = ()) -> DataFrame:
    """n, mediator_effect, direct, total: the effect of t on y with the mediator held, though `between` comes after t and confounds mediator and outcome.

    First y on t, `before`, `between` and the mediator; then y less the mediator's part, on t and
    `before` alone. Both come from one matrix of moments, as the corrected outcome is linear in its columns.
    """
    g = Gram(df, [t, *before, *between, mediator, y])
    slopes = g.ols(y, [t, *before, *between, mediator])[0]
    b = float(slopes[-1])
    base = [t, *before]
    i, k, m = [g.columns.index(c) for c in base], g.columns.index(y), g.columns.index(mediator)
    direct = np.linalg.lstsq(g.cov[np.ix_(i, i)], g.cov[i, k] - b * g.cov[i, m], rcond=None)[0][0]
    return spark.createDataFrame([(g.n, b, float(direct), float(g.ols(y, base)[0][0]))], "n long, mediator_effect double, direct double, total double")


def longitudinal_mediation(spark: SparkSession, df: DataFrame, t: str, mediators: Sequence[str], y: str) -> DataFrame:
    """step, direct, indirect, total: with the mediators up to each step, what of the effect of t goes around them and through them; one scan."""
    g = Gram(df, [t, *mediators, y])
    rows = []
    for k in range(1, len(mediators) + 1):
        met = list(mediators[:k])
        slopes = g.ols(y, [t, *met])[0]
        through = sum(float(g.ols(m, [t])[0][0]) * float(b) for m, b in zip(met, slopes[1:], strict=True))
        rows.append((k, float(slopes[0]), through, float(slopes[0]) + through))
    return spark.createDataFrame(rows, "step int, direct double, indirect double, total double")


def sequential_backdoor(edges: Iterable[tuple], treatments: Sequence[str], y: str, sets: Sequence[Iterable[str]]) -> bool:
    """Whether the sets, one a treatment in order, let the effect of all treatments be adjusted for step by step.

    Each set holds no descendant of its treatment or a later one, and with the earlier treatments and
    sets separates the treatment from y where its own arrows out and those into later ones are cut.
    """
    edges = list(edges)
    known: set[str] = set()
    for k, (x, z) in enumerate(zip(treatments, sets, strict=True)):
        z, later = set(z), list(treatments[k:])
        if any(set(later) & (ancestors(edges, {v}) - {v}) for v in z):
            return False
        known |= z
        if not d_separated(cut(edges, [], into=set(treatments[k + 1 :]), out={x})[0], x, y, known | set(treatments[:k])):
            return False
    return True
