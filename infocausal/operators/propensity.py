"""Propensity models and what uses them. Fitting is a few aggregations of small matrices; scoring is a Column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _linear(b: np.ndarray, xs: list[str]) -> Column:
    out = F.lit(float(b[0]))
    for w, x in zip(b[1:], xs, strict=True):
        out = out + float(w) * F.col(x)
    return out


def logistic(df: DataFrame, t: str, xs: list[str], rounds: int = 25, ridge: float = 1e-8) -> np.ndarray:
    """Intercept and slopes by Newton steps; a step is one aggregation of the gradient and the (p + 1)^2 curvature."""
    k = len(xs) + 1
    b = np.zeros(k)
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_linear(b, xs)))
        rows = df.select(F.col(t).cast("double").alias("_t"), p.alias("_p"), *[c.alias(f"_{i}") for i, c in enumerate(cols)])
        g = [F.sum((F.col("_t") - F.col("_p")) * F.col(f"_{i}")).alias(f"g{i}") for i in range(k)]
        h = [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = rows.agg(*g, *h).first()
        curve = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
        step = np.linalg.solve(curve, np.array([r[f"g{i}"] or 0.0 for i in range(k)]))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


def score(b: np.ndarray, xs: list[str], clip: float = 0.01) -> Column:
    return F.greatest(F.lit(clip), F.least(F.lit(1 - clip), 1 / (1 + F.exp(-_linear(b, xs)))))


def ipw(df: DataFrame, e: Column) -> DataFrame:
    """ate and its standard error with stabilised weights; columns t, y."""
    d = df.select("t", "y", e.alias("e")).withColumn("w", F.when(F.col("t") == 1, 1 / F.col("e")).otherwise(1 / (1 - F.col("e"))))
    mean = lambda k: F.sum(F.when(F.col("t") == k, F.col("w") * F.col("y"))) / F.sum(F.when(F.col("t") == k, F.col("w")))
    m = d.agg(mean(1).alias("m1"), mean(0).alias("m0"))
    inf = F.when(F.col("t") == 1, F.col("w") * (F.col("y") - F.col("m1"))).otherwise(-F.col("w") * (F.col("y") - F.col("m0")))
    return d.crossJoin(F.broadcast(m)).agg(F.first(F.col("m1") - F.col("m0")).alias("ate"), (F.sqrt(F.var_pop(inf) / F.count("*"))).alias("se"))  # one row


def doubly_robust(df: DataFrame, e: Column, mu1: Column, mu0: Column) -> DataFrame:
    d = df.select("t", "y", e.alias("e"), mu1.alias("m1"), mu0.alias("m0"))
    one = F.col("m1") + F.col("t") * (F.col("y") - F.col("m1")) / F.col("e")
    zero = F.col("m0") + (1 - F.col("t")) * (F.col("y") - F.col("m0")) / (1 - F.col("e"))
    return d.agg(F.avg(one - zero).alias("ate"), F.sqrt(F.var_samp(one - zero) / F.count("*")).alias("se"))


def stratified(df: DataFrame, e: Column, k: int) -> DataFrame:
    """Effect over k quantile strata of the score; the cuts are k - 1 approximate quantiles."""
    from infocausal.operators.effects import stratified as by_z

    d = df.select("t", "y", e.alias("e"))
    cuts = d.approxQuantile("e", [i / k for i in range(1, k)], 0.001)
    z = F.lit(0)
    for c in cuts:
        z = z + (F.col("e") > c).cast("int")
    return by_z(d.withColumn("z", z))


def outcome_models(df: DataFrame, xs: list[str]) -> tuple[Column, Column]:
    """Least squares of y on xs in each arm, as columns for treated and untreated."""
    from infocausal.operators.dependence import Gram

    out = []
    for arm in (1, 0):
        b, b0, _ = Gram(df.filter(F.col("t") == arm), ["y", *xs]).ols("y", xs)
        out.append(_linear(np.array([b0, *b]), xs))
    return out[0], out[1]


def cross_fitted(df: DataFrame, xs: list[str], key: str, folds: int = 2) -> DataFrame:
    """Partially linear effect of t on y: residuals from the other folds' models, folds by a hash of the key."""
    from infocausal.operators.dependence import Gram

    d = df.select("t", "y", *xs, F.pmod(F.xxhash64(key), F.lit(folds)).alias("_f")).withColumn("t", F.col("t").cast("double"))
    parts = None
    for f in range(folds):
        rest = Gram(d.filter(F.col("_f") != f), ["t", "y", *xs])
        (bt, t0, _), (by, y0, _) = rest.ols("t", xs), rest.ols("y", xs)
        own = d.filter(F.col("_f") == f).select((F.col("t") - _linear(np.array([t0, *bt]), xs)).alias("rt"), (F.col("y") - _linear(np.array([y0, *by]), xs)).alias("ry"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.agg((F.sum(F.col("rt") * F.col("ry")) / F.sum(F.col("rt") * F.col("rt"))).alias("effect"), F.count("*").alias("n"))


def signed_rank_bounds(pairs: DataFrame, gammas: list[float], d: str = "d") -> DataFrame:
    """gamma, w, z: signed-rank statistic of paired differences with its largest mean under hidden bias gamma.

    Ranks (ties averaged) are running counts over distinct absolute differences, aggregated first, so
    what one task puts in order is the table of distinct values.
    """
    a = pairs.select(F.abs(d).alias("a"), F.col(d).alias("d")).filter("d != 0")
    c = a.groupBy("a").agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.select("n", "pos", (before + (F.col("n") + 1) / 2).alias("rank"))
    s = r.agg(F.sum(F.col("pos") * F.col("rank")).alias("w"), F.sum(F.col("n") * F.col("rank")).alias("total"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("squares"))
    g = s.withColumn("gamma", F.explode(F.array(*[F.lit(float(x)) for x in gammas])))
    p = F.col("gamma") / (1 + F.col("gamma"))
    return g.select("gamma", "w", ((F.col("w") - p * F.col("total")) / F.sqrt(p * (1 - p) * F.col("squares"))).alias("z"))
