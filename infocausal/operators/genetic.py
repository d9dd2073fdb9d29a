"""Matching on a weighted Mahalanobis metric, and a search for the weights that balance best.

Covariates are whitened by the Cholesky factor of their covariance (one scan), so the metric is a
distance of scaled coordinates. All weights of a generation are tried in one plan, as a column of
candidates; the driver holds the population and gets a row of scores for each member.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infocausal.operators.dependence import Gram
from infocausal.operators.nearest import nearest_within


def whitened(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """df with w0, w1 ..: uncorrelated combinations of the covariates with variance one, in which plain distance is Mahalanobis'. Rows without a covariate are left out; a covariate that others determine adds nothing."""
    g = Gram(df, list(xs))
    p = len(xs)
    scale = np.sqrt(np.maximum(np.diag(g.cov), 0))
    varies = scale > 1e-9 * np.maximum(np.abs(g.mean), 1)
    corr = g.corr()
    # Row by row: what a covariate has beyond those before it. The same as the inverse of the Cholesky factor, and safe where that has a zero.
    rows = np.zeros((p, p))
    for i in range(p):
        before = corr[:i, :i]
        slopes = np.linalg.pinv(before) @ corr[:i, i] if i else np.zeros(0)
        rest = 1 - slopes @ corr[:i, i]
        if varies[i] and rest > 1e-10:
            rows[i, i], rows[i, :i] = 1, -slopes
            rows[i] /= np.sqrt(rest)
    z = [(F.col(x).cast("double") - float(m)) / float(s if v else 1.0) for x, m, s, v in zip(xs, g.mean, scale, varies, strict=True)]
    made = [sum((F.lit(float(b)) * c for b, c in zip(r, z, strict=True) if b), F.lit(0.0)) for r in rows]
    return df.na.drop(subset=list(xs)).withColumns({f"w{i}": c for i, c in enumerate(made)})


def weighted_matches(df: DataFrame, xs: Sequence[str], key: str, weights: Sequence[Sequence[float]], caliper: float) -> DataFrame:
    """candidate, k, match, distance, y, y_match and <x>, <x>_match: each treated row's nearest control within the caliper for each list of weights, ties to the smaller key.

    The search goes from small cells to the caliper (nearest_within).
    """
    p = len(xs)
    scaled = F.array(*[F.struct(F.lit(c).alias("candidate"), *[F.lit(float(np.sqrt(w))).alias(f"s{i}") for i, w in enumerate(ws)]) for c, ws in enumerate(weights)])
    z = whitened(df, xs).select(F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y"), F.col(key).alias("k"), *xs, *[f"w{i}" for i in range(p)])
    z = z.select("*", F.explode(scaled).alias("_s")).select("t", "y", "k", *xs, F.col("_s.candidate").alias("candidate"), *[(F.col(f"w{i}") * F.col(f"_s.s{i}")).alias(f"z{i}") for i in range(p)])
    at = [f"z{i}" for i in range(p)]
    carried = [f"{x}_match" for x in xs]
    two = z.filter("t = 0").select("candidate", F.col("k").alias("match"), F.col("y").alias("y_match"), *[F.col(x).alias(c) for x, c in zip(xs, carried, strict=True)], *at)
    best = nearest_within(z.filter("t = 1").select("candidate", "k", "y", *xs, *at), two, at, caliper, "match", ["candidate"])
    return best.select("candidate", "k", "match", "distance", "y", "y_match", *xs, *carried)


def match_scores(df: DataFrame, xs: Sequence[str], key: str, weights: Sequence[Sequence[float]], caliper: float) -> DataFrame:
    """candidate, n, share (of the treated that have a match), att, imbalance: the largest difference of means between matched groups, in standard deviations of the treated."""
    m = weighted_matches(df, xs, key, weights, caliper)
    own = df.na.drop(subset=list(xs)).filter("t = 1").agg(F.count("*").alias("_n"), *[F.stddev_samp(x).alias(f"_s_{x}") for x in xs]).first()
    gap = [F.abs(F.avg(F.col(x).cast("double") - F.col(f"{x}_match"))) / F.lit(own[f"_s_{x}"] or 1.0) for x in xs]
    s = m.groupBy("candidate").agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("y_match")).alias("att"), F.greatest(F.lit(0.0), *gap).alias("imbalance"))
    return s.select("candidate", "n", (F.col("n") / F.lit(max(own["_n"], 1))).alias("share"), "att", "imbalance")


def genetic_match(spark: SparkSession, df: DataFrame, xs: Sequence[str], key: str, caliper: float, population: int = 8, generations: int = 4, seed: int = 1) -> DataFrame:
    """generation, weights, n, share, att, imbalance: the best weights of each generation, by imbalance plus the share left without a match.

    The first generation holds equal weights and random ones. The better half stays; the others are
    mixtures of two of it, with their logarithms disturbed. So the last row is never worse than equal weights.
    """
    rng, p = np.random.default_rng(seed), len(xs)
    members = [np.ones(p), *[np.exp(rng.normal(size=p)) for _ in range(population - 1)]]
    known: dict[tuple, dict] = {}
    out = []
    for g in range(generations):
        new = [w for w in dict.fromkeys(tuple(round(float(x), 6) for x in m) for m in members) if w not in known]
        if new:
            found = {r["candidate"]: r.asDict() for r in match_scores(df, xs, key, new, caliper).collect()}  # a row a member
            known |= {w: found.get(i, {"n": 0, "share": 0.0, "att": None, "imbalance": float("inf")}) for i, w in enumerate(new)}
        ranked = sorted(known, key=lambda w: (round(known[w]["imbalance"] + 1 - known[w]["share"], 9), w))
        best = known[ranked[0]]
        out.append((g, list(ranked[0]), best["n"], best["share"], best["att"], best["imbalance"]))
        parents = [np.array(w) for w in ranked[: max(population // 2, 1)]]
        mixed = [np.exp(np.log(parents[rng.integers(len(parents))]) * (u := rng.random()) + np.log(parents[rng.integers(len(parents))]) * (1 - u) + 0.3 * rng.normal(size=p)) for _ in range(population - len(parents))]
        members = [*parents, *mixed]
    return spark.createDataFrame(out, "generation int, weights array<double>, n long, share double, att double, imbalance double")
