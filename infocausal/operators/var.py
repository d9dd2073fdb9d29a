"""Vector autoregression: lags are window columns, the fit is one aggregation of cross-products.

The data enter as a wide frame (t and one column a variable) or in long form; what the driver gets
is a matrix of (p k)^2 moments, whatever the number of rows. Responses, variance shares and spectra
are small matrix formulas on the fitted coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.functions.special import f_sf
from infocausal.operators.dependence import Gram


def wide(long: DataFrame, names: list[str], series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """t and a column for each name; times that lack one are left out."""
    return long.filter(F.col(series).isin(names)).groupBy(t).pivot(series, names).agg(F.first(v)).na.drop()


def lagged(df: DataFrame, names: list[str], order: int, t: str = "t", block: str | None = None) -> DataFrame:
    """Columns <name>_0 to <name>_<order>, rows with gaps left out. `block` partitions the window (panels);
    without it time is cut into long overlapping pieces, so that no single task sorts the series."""
    if block is None:
        size = 100_000
        piece = F.floor(F.col(t) / size)
        both = F.array_distinct(F.array(piece, F.floor((F.col(t) + order) / size)))
        df = df.withColumn("_own", piece).withColumn("_piece", F.explode(both))
        block = "_piece"
    w = Window.partitionBy(block).orderBy(t)
    cols = [F.lag(n, i).over(w).alias(f"{n}_{i}") for n in names for i in range(order + 1)]
    own = [F.col("_own") == F.col("_piece")] if "_own" in df.columns else [F.lit(True)]
    out = df.select(F.col(t).alias("_t"), F.lag(t, order).over(w).alias("_first"), own[0].alias("_mine"), *cols)
    return out.filter((F.col("_t") - F.col("_first") == order) & F.col("_mine")).drop("_t", "_first", "_mine")


@dataclass(frozen=True)
class Var:
    names: tuple[str, ...]
    order: int
    n: int
    #: order x k x k: coefficient of variable j, lag i + 1, in the equation of each row.
    a: np.ndarray
    sigma: np.ndarray
    gram: Gram

    def responses(self, steps: int, orthogonal: bool = False) -> np.ndarray:
        """steps + 1 matrices; the first is the identity, or the Cholesky factor."""
        k = len(self.names)
        out = [np.eye(k)]
        for h in range(1, steps + 1):
            out.append(sum(self.a[i] @ out[h - 1 - i] for i in range(min(self.order, h))))
        root = np.linalg.cholesky(self.sigma) if orthogonal else np.eye(k)
        return np.stack(out) @ root

    def variance_shares(self, steps: int) -> np.ndarray:
        """Forecast error variance of each row's variable by each column's shock; rows sum to 1."""
        s = (self.responses(steps - 1, True) ** 2).sum(0)
        return s / s.sum(1, keepdims=True)

    def granger(self, target: str, source: str, given: list[str] | None = None) -> tuple[float, float]:
        """F and its tail: the source's lags in the target's equation, beside its own and those of `given`."""
        lags = lambda v: [f"{v}_{i}" for i in range(1, self.order + 1)]
        own = [c for v in [target, *(given or [])] for c in lags(v)]
        less = self.gram.ols(f"{target}_0", own)[2]
        full = self.gram.ols(f"{target}_0", own + lags(source))[2]
        dof = self.n - len(own) - self.order - 1
        f = (less - full) / self.order / (full / dof) if full > 0 and dof > 0 else 0.0
        return float(f), f_sf(f, self.order, dof)

    def generalized_shares(self, steps: int) -> np.ndarray:
        """Forecast error variance by shocks that need no order of the variables; rows are scaled to 1."""
        psi = self.responses(steps - 1)
        hit = sum((p @ self.sigma) ** 2 for p in psi) / np.diag(self.sigma)
        share = hit / np.diag(sum(p @ self.sigma @ p.T for p in psi))[:, None]
        return share / share.sum(1, keepdims=True)

    def intercept(self) -> np.ndarray:
        mean = self.gram.mean[self.gram._at([f"{v}_0" for v in self.names])]
        return mean - sum(a @ mean for a in self.a)

    def forecast(self, last: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard errors of the next steps; last: the `order` newest rows, oldest first."""
        rows, c = [np.asarray(x, float) for x in last][-self.order :], self.intercept()
        for _ in range(steps):
            rows.append(c + sum(a @ rows[-1 - i] for i, a in enumerate(self.a)))
        psi = self.responses(steps - 1)
        var = np.cumsum([np.diag(p @ self.sigma @ p.T) for p in psi], axis=0)
        return np.stack(rows[-steps:]), np.sqrt(var)

    def partial_granger(self, target: str, source: str, given: list[str]) -> float:
        """ln of the target's error variance without and with the source, each given the errors of `given`, which takes out their common hidden input."""
        def error(names: list[str]) -> float:
            past = [f"{v}_{i}" for v in names for i in range(1, self.order + 1)]
            now = [f"{v}_0" for v in [target, *given]]
            at, to = self.gram._at(past), self.gram._at(now)
            b = np.linalg.lstsq(self.gram.cov[np.ix_(at, at)], self.gram.cov[np.ix_(at, to)], rcond=None)[0]
            s = self.gram.cov[np.ix_(to, to)] - b.T @ self.gram.cov[np.ix_(at, to)]
            return float(s[0, 0] - s[0, 1:] @ np.linalg.pinv(s[1:, 1:]) @ s[1:, 0]) if given else float(s[0, 0])

        return float(np.log(error([target, *given]) / error([target, source, *given])))

    def geweke(self, target: str, source: str, frequencies: np.ndarray) -> np.ndarray:
        """Causality by frequency (0 to one half) from source to target, of the model of all variables; the other errors are made orthogonal to the source's."""
        i, j = self.names.index(target), self.names.index(source)
        out = []
        own = self.sigma[j, j] - self.sigma[i, j] ** 2 / self.sigma[i, i]
        for f in frequencies:
            h = np.linalg.inv(self._transfer(f))
            s = np.real((h @ self.sigma @ h.conj().T)[i, i])
            out.append(np.log(s / max(s - own * abs(h[i, j]) ** 2, 1e-300)))
        return np.array(out)

    def geweke_parts(self, x: str, y: str) -> dict[str, float]:
        """Linear dependence of two variables: x to y, y to x, instantaneous and total (their sum)."""
        one = lambda v: self.gram.ols(f"{v}_0", [f"{v}_{i}" for i in range(1, self.order + 1)])[2]
        past = [f"{v}_{i}" for v in (x, y) for i in range(1, self.order + 1)]
        sx, sy = (self.gram.ols(f"{v}_0", past)[2] for v in (x, y))
        at, to = self.gram._at(past), self.gram._at([f"{x}_0", f"{y}_0"])
        b = np.linalg.lstsq(self.gram.cov[np.ix_(at, at)], self.gram.cov[np.ix_(at, to)], rcond=None)[0]
        det = float(np.linalg.det(self.gram.cov[np.ix_(to, to)] - b.T @ self.gram.cov[np.ix_(at, to)]))
        parts = {"x_to_y": np.log(one(y) / sy), "y_to_x": np.log(one(x) / sx), "instant": np.log(sx * sy / det)}
        return {**{k: float(v) for k, v in parts.items()}, "total": float(sum(parts.values()))}

    def causal_edges(self, alpha: float = 0.05) -> list[tuple[str, str, float]]:
        """source, target, p of the links that the test given all other variables finds, at a level corrected for their number."""
        k = len(self.names)
        found = [(s, t, self.granger(t, s, [g for g in self.names if g not in (s, t)])[1]) for s in self.names for t in self.names if s != t]
        return sorted((x for x in found if x[2] < alpha / (k * (k - 1))), key=lambda x: (x[2], x[0], x[1]))

    def _transfer(self, frequency: float) -> np.ndarray:
        z = np.exp(-2j * np.pi * frequency * np.arange(1, self.order + 1))
        return np.eye(len(self.names)) - np.tensordot(z, self.a, 1)

    def spectrum(self, frequency: float) -> np.ndarray:
        h = np.linalg.inv(self._transfer(frequency))
        return h @ self.sigma @ h.conj().T

    def coherence(self, frequency: float) -> np.ndarray:
        s = self.spectrum(frequency)
        d = np.real(np.diag(s))
        return np.abs(s) ** 2 / np.outer(d, d)

    def partial_directed_coherence(self, frequency: float) -> np.ndarray:
        """Column j to row i; columns of squares sum to 1."""
        a = np.abs(self._transfer(frequency))
        return a / np.sqrt((a**2).sum(0))

    def stable(self) -> bool:
        k, p = len(self.names), self.order
        c = np.zeros((k * p, k * p))
        c[:k] = np.hstack(list(self.a))
        c[k:, :-k] = np.eye(k * (p - 1))
        return bool((np.abs(np.linalg.eigvals(c)) < 1).all())


def fit(df: DataFrame, names: list[str], order: int, t: str = "t") -> Var:
    rows = lagged(df, names, order, t)
    gram = Gram(rows, [f"{v}_{i}" for v in names for i in range(order + 1)])
    past = [f"{v}_{i}" for i in range(1, order + 1) for v in names]
    at, now = gram._at(past), gram._at([f"{v}_0" for v in names])
    b = np.linalg.lstsq(gram.cov[np.ix_(at, at)], gram.cov[np.ix_(at, now)], rcond=None)[0]
    sigma = gram.cov[np.ix_(now, now)] - b.T @ gram.cov[np.ix_(at, now)]
    k = len(names)
    return Var(tuple(names), order, gram.n, np.stack([b[i * k : (i + 1) * k].T for i in range(order)]), sigma, gram)


def choose_order(df: DataFrame, names: list[str], most: int, t: str = "t") -> int:
    """The order with the least AIC; all orders use the rows of the largest, from one aggregation."""
    gram = Gram(lagged(df, names, most, t), [f"{v}_{i}" for v in names for i in range(most + 1)])
    now = gram._at([f"{v}_0" for v in names])

    def aic(order: int) -> float:
        at = gram._at([f"{v}_{i}" for i in range(1, order + 1) for v in names])
        b = np.linalg.lstsq(gram.cov[np.ix_(at, at)], gram.cov[np.ix_(at, now)], rcond=None)[0]
        sigma = gram.cov[np.ix_(now, now)] - b.T @ gram.cov[np.ix_(at, now)]
        return float(np.linalg.slogdet(sigma)[1] + 2 * order * len(names) ** 2 / gram.n)

    return min(range(1, most + 1), key=aic)
