"""Correlation, conditional independence, least squares and local scores from one pass of moments."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def correlation_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs of columns, in one aggregation; 0 where a side is constant."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    row = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(F.col(f"`{a}|{b}`"), F.lit(None).cast("double")), F.lit(0.0)).alias("r"))
    return wide.select(F.explode(F.array(*[row(a, b) for a, b in pairs])).alias("x")).select("x.*")


def partial_correlation(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """r given one column, Fisher's z and the test statistic sqrt(n - 4) z."""
    m = df.agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"), F.count("*").alias("n"))
    r = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    m = m.select("n", r.alias("r"))
    return m.select("n", "r", F.atanh("r").alias("fisher_z"), (F.sqrt(F.col("n") - 4) * F.atanh("r")).alias("statistic"))


class Gram:
    """Centred cross-products of a few columns: p squared numbers, however many rows there are."""

    def __init__(self, df: DataFrame, columns: list[str]):
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().agg(
            F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        self.columns, self.n = columns, row["n"]
        self.mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
        self.cov = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            self.cov[i, j] = self.cov[j, i] = row[f"c{i}_{j}"] or 0.0

    @classmethod
    def of_moments(cls, columns: list[str], row: dict) -> Gram:
        """From n, means m<i> and covariances c<i>_<j> that are known already."""
        g, p = cls.__new__(cls), len(columns)
        g.columns, g.n = columns, row["n"]
        g.mean = np.array([row[f"m{i}"] for i in range(p)], float)
        g.cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
        return g

    def _at(self, names: list[str]) -> list[int]:
        return [self.columns.index(c) for c in names]

    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cov))
        scale = np.outer(sd, sd)
        return np.divide(self.cov, scale, out=np.zeros_like(scale), where=scale > 1e-24) * (1 - np.eye(len(sd))) + np.eye(len(sd))

    def partial(self, x: str, y: str, given: list[str]) -> float:
        i = self._at([x, y, *given])
        inverse = np.linalg.pinv(self.corr()[np.ix_(i, i)])
        return float(np.clip(-inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]), -1, 1))

    def fisher_p(self, x: str, y: str, given: list[str]) -> float:
        from infocausal.functions.special import normal_sf

        r = min(max(self.partial(x, y, given), -1 + 1e-12), 1 - 1e-12)
        return 2 * normal_sf(abs(np.arctanh(r)) * np.sqrt(max(self.n - len(given) - 3, 1)))

    def ols(self, y: str, xs: list[str]) -> tuple[np.ndarray, float, float]:
        """Slopes, intercept and residual sum of squares over n."""
        i, k = self._at(xs), self._at([y])[0]
        if not xs:
            return np.zeros(0), float(self.mean[k]), float(self.cov[k, k])
        b = np.linalg.lstsq(self.cov[np.ix_(i, i)], self.cov[i, k], rcond=None)[0]
        return b, float(self.mean[k] - b @ self.mean[i]), float(max(self.cov[k, k] - b @ self.cov[i, k], 0))

    def bic(self, y: str, parents: list[str]) -> float:
        return -self.n * np.log(max(self.ols(y, parents)[2], 1e-300)) - (len(parents) + 1) * np.log(self.n)

    def aic(self, y: str, parents: list[str]) -> float:
        return -self.n * np.log(max(self.ols(y, parents)[2], 1e-300)) - 2 * (len(parents) + 1)


def g_squared(df: DataFrame, x: str, y: str, z: list[str] | None = None, least: int = 5) -> DataFrame:
    """g2, dof over the strata of z that have `least` rows."""
    z = z or []
    c = df.groupBy(x, y, *z).agg(F.count("*").alias("n"))
    of = lambda *cols: F.sum("n").over(Window.partitionBy(*cols, *z))
    c = c.select(x, y, *z, "n", of().alias("t"), of(x).alias("nx"), of(y).alias("ny")).filter(F.col("t") >= least)
    per = c.groupBy(*z).agg(
        F.sum(2 * F.col("n") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("g"),
        ((F.count_distinct(x) - 1) * (F.count_distinct(y) - 1)).alias("d"),
    )
    return per.agg(F.sum("g").alias("g2"), F.sum("d").cast("long").alias("dof"))


def two_regressors(df: DataFrame, y: Column, x1: Column, x2: Column) -> DataFrame:
    """b0, b1, b2, sigma2 (over n), n of least squares on two regressors, in one aggregation."""
    m = df.select(y.cast("double").alias("y"), x1.cast("double").alias("a"), x2.cast("double").alias("b")).agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        *[F.covar_pop(p, q).alias(p + q) for p, q in ("aa", "bb", "ab", "ay", "by", "yy")],
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumn("b1", (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det)
    m = m.withColumn("b2", (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det)
    return m.select(
        "n", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("b0"), "b1", "b2",
        (F.col("yy") - F.col("b1") * F.col("ay") - F.col("b2") * F.col("by")).alias("sigma2"),
    )
