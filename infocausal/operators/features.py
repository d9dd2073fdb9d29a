"""Kernel tests on random Fourier features: dependence, conditional dependence, nonlinear regression.

A Gaussian kernel of width w is the mean product of cosines with normal frequencies, so a kernel
matrix of all rows becomes a matrix of a few dozen feature moments, which one scan yields however
many rows there are. Frequencies and phases follow from a seed and are literals of the plan. Each
task sends the moments of its rows; the driver solves systems of the size of the features.

Rows with a null in a used column are left out. A constant column has no feature that varies: its
statistic is 0 and its p is 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.functions.special import chi2_sf, f_sf

#: Sign draws that one hash of a row yields.
SIGNS = 60


@dataclass(frozen=True)
class Cosines:
    """sqrt(2 / D) cos(w . z + b) for D frequencies of some standardised columns; width in standard deviations."""

    weights: tuple[tuple[float, ...], ...]
    phases: tuple[float, ...]

    @classmethod
    def drawn(cls, columns: int, d: int, seed: int = 0, width: float = 1.0) -> Cosines:
        rng = np.random.default_rng((seed, columns, d))
        w, b = rng.normal(size=(d, columns)) / width, rng.uniform(0, 2 * np.pi, d)
        return cls(tuple(tuple(round(float(x), 6) for x in r) for r in w), tuple(round(float(x), 6) for x in b))

    @property
    def d(self) -> int:
        return len(self.phases)

    def columns(self, z: Sequence[Column]) -> list[Column]:
        return [
            F.sqrt(F.lit(2.0 / self.d)) * F.cos(sum((x * c for x, c in zip(w, z, strict=True)), F.lit(b)))
            for w, b in zip(self.weights, self.phases, strict=True)
        ]

    def sql(self, z: Sequence[str]) -> list[str]:
        """The same features as SQL text over standardised columns."""
        return [
            f"sqrt(2.0::DOUBLE / {self.d}) * cos({b}::DOUBLE" + "".join(f" + {x}::DOUBLE * {c}" for x, c in zip(w, z, strict=True)) + ")"
            for w, b in zip(self.weights, self.phases, strict=True)
        ]


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns less their mean, over their (population) standard deviation; a constant one is 0. Other columns stay."""
    df = df.na.drop(subset=list(columns))
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = lambda i, c: (F.col(c).cast("double") - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"s{i}"] or 1.0)
    return df.withColumns({c: scale(i, c) for i, c in enumerate(columns)})


class Moments:
    """n, means and covariances of some columns: a row of sums from each task, added up by place."""

    def __init__(self, df: DataFrame, columns: list[Column], label: str = "x"):
        m = len(columns)
        rows = df.select(F.array(*columns).alias(label))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((m + 1, m))
            for batch in it:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                n += len(x)
                total[0] += x.sum(0)
                total[1:] += x.T @ x
            if n:
                flat = np.concatenate([[n], total.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

        got = {r["at"]: r["v"] for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([got.get(i, 0.0) for i in range(1 + m * (m + 1))])
        self.n = int(flat[0])
        total = flat[1:].reshape(m + 1, m) / max(self.n, 1)
        self.mean = total[0]
        self.cov = total[1:] - np.outer(self.mean, self.mean)


def partialled(cov: np.ndarray, kept: list[int], given: list[int], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of `kept` less what a ridge regression on `given` explains, and the regression's slopes."""
    if not given:
        return cov[np.ix_(kept, kept)], np.zeros((0, len(kept)))
    slopes = np.linalg.solve(cov[np.ix_(given, given)] + ridge * np.eye(len(given)), cov[np.ix_(given, kept)])
    return cov[np.ix_(kept, kept)] - cov[np.ix_(kept, given)] @ slopes, slopes


def gamma_p(statistic: float, a: np.ndarray, b: np.ndarray) -> float:
    """Tail of the gamma law with the mean and variance of the statistic under independence; a, b: covariances of both sides."""
    mean, var = float(np.trace(a) * np.trace(b)), float(2 * (a * a).sum() * (b * b).sum())
    return 1.0 if min(mean, var) <= 1e-20 else chi2_sf(2 * statistic * mean / var, 2 * mean * mean / var)


@dataclass(frozen=True)
class KernelTest:
    """Features a side, of the condition, their widths, the ridge, and sign replicates (rounded up to whole hashes).

    The condition has more features and a small ridge: what its regression leaves unexplained counts as dependence.
    """

    d: int = 8
    d_given: int = 30
    width: float = 1.0
    ridge: float = 1e-6
    replicates: int = 120
    seed: int = 0

    def sides(self, given: int) -> tuple[Cosines, Cosines, Cosines | None]:
        """The first side's features see the condition as well, without which some dependence given it is missed."""
        own = Cosines.drawn(1 + given, self.d, self.seed + 1, self.width)
        return own, Cosines.drawn(1, self.d, self.seed + 2, self.width), Cosines.drawn(given, self.d_given, self.seed + 3, self.width) if given else None


def signs(key: Sequence[str], words: int) -> list[Column]:
    """Longs with SIGNS random bits that the row's key decides."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return [F.conv(F.substring(F.md5(F.concat(name, F.lit(f"|{i}"))), 1, 15), 16, 10).cast("long") for i in range(words)]


def kernel_test(df: DataFrame, x: str, y: str, given: Sequence[str] = (), key: Sequence[str] = (), p: KernelTest = KernelTest()) -> DataFrame:
    """x, y, given, n, statistic, p (gamma approximation), p_signs (share of sign replicates that reach the statistic; null without a key).

    The statistic is n times the squared norm of the covariance of both sides' features, less what
    ridge regression on the condition's features explains. A replicate gives the rows' products of
    residuals random signs, which leaves no dependence; all replicates share the second scan.
    """
    return kernel_tests(df.na.drop(subset=[x, y, *given]), [(x, y, given)], key, p)


def kernel_tests(df: DataFrame, tests: Sequence[tuple[str, str, Sequence[str]]], key: Sequence[str] = (), p: KernelTest = KernelTest()) -> DataFrame:
    """kernel_test for each (x, y, given), a row each, all of them in the same scans: one for means, one for moments, one for the signs.

    Features that several tests use are made once, and a row's key is hashed once. Where nulls give
    the tests different rows, each test scans its own.
    """
    spark: SparkSession = df.sparkSession
    names = list(dict.fromkeys(c for x, y, given in tests for c in (x, y, *given)))
    df = df.select(*dict.fromkeys([*names, *key]))
    if len(tests) > 1 and df.agg(F.coalesce(F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in names], F.lit(0))), F.lit(0))).first()[0]:
        return reduce(DataFrame.unionByName, [kernel_test(df, *t, key, p) for t in tests])
    z = standardised(df, names)
    made: dict[tuple, int] = {}
    features: list[Column] = []

    def places(f: Cosines | None, columns: Sequence[str]) -> list[int]:
        if f is None:
            return []
        if (f, tuple(columns)) not in made:
            made[f, tuple(columns)] = len(features)
            features.extend(f.columns([F.col(c) for c in columns]))
        return list(range(made[f, tuple(columns)], made[f, tuple(columns)] + f.d))

    at = [[places(f, c) for f, c in zip(p.sides(len(given)), ([x, *given], [y], given), strict=True)] for x, y, given in tests]
    m = Moments(z, features)
    found = []
    for a, b, c in at:
        left, slopes = partialled(m.cov, [*a, *b], c, p.ridge)
        cross = left[: len(a), len(a) :]
        by_gamma = gamma_p(float(m.n * (cross * cross).sum()), left[: len(a), : len(a)], left[len(a) :, len(a) :]) if m.n > 1 else 1.0
        found.append((float(m.n * (cross * cross).sum()), by_gamma, slopes, cross))
    by_signs = _sign_p(z, features, m, at, [f[2] for f in found], [f[3] for f in found], key, [f[0] for f in found], p) if key and m.n > 1 else [None] * len(tests)
    rows = [(x, y, ",".join(given), m.n, f[0], f[1], s) for (x, y, given), f, s in zip(tests, found, by_signs, strict=True)]
    return spark.createDataFrame(rows, "x string, y string, given string, n long, statistic double, p double, p_signs double")


def _sign_p(z: DataFrame, features: list[Column], m: Moments, at: list, slopes: list[np.ndarray], cross: list[np.ndarray], key: Sequence[str], statistics: list[float], p: KernelTest) -> list[float]:
    words = -(-p.replicates // SIGNS)
    rows = z.select(F.array(*features).alias("f"), *[s.alias(f"s{i}") for i, s in enumerate(signs(key, words))])
    mean, size = m.mean, len(features)
    width = [c.size for c in cross]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words * SIGNS, sum(width)))
        for batch in it:
            f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - mean
            products = []
            for (a, b, c), s, x in zip(at, slopes, cross, strict=True):
                r = f[:, [*a, *b]] - f[:, c] @ s
                products.append((r[:, : len(a), None] * r[:, None, len(a) :]).reshape(len(r), -1) - x.ravel())
            product = np.concatenate(products, axis=1)
            for i in range(words):
                bits = batch.column(f"s{i}").to_numpy()[:, None] >> np.arange(SIGNS) & 1
                total[i * SIGNS : (i + 1) * SIGNS] += (2.0 * bits - 1).T @ product
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

    # A number for each replicate and pair of features.
    got = {r["at"]: r["v"] for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    drawn = np.array([got[i] for i in range(words * SIGNS * sum(width))]).reshape(words * SIGNS, -1)
    t = [(v * v).sum(1) / m.n for v in np.split(drawn, np.cumsum(width)[:-1], axis=1)]
    return [float((1 + (d >= s).sum()) / (1 + words * SIGNS)) for d, s in zip(t, statistics, strict=True)]


@dataclass(frozen=True)
class Fit:
    """y by ridge regression on features of standardised columns: intercept and slopes, the shares of variance, and the residual as a column."""

    features: Cosines
    inputs: tuple[str, ...]
    y: str
    mean: np.ndarray
    slopes: np.ndarray
    y_mean: float
    n: int
    r2: float

    def predicted(self) -> Column:
        f = self.features.columns([F.col(c) for c in self.inputs])
        return sum((F.lit(float(b)) * (c - F.lit(float(m))) for b, c, m in zip(self.slopes, f, self.mean, strict=True)), F.lit(self.y_mean))

    def residual(self) -> Column:
        return F.col(self.y) - self.predicted()


def ridge_fit(z: DataFrame, y: str, inputs: Sequence[str], features: Cosines, ridge: float = 1e-3) -> Fit:
    """z: standardised inputs (and y as it is)."""
    m = Moments(z, [*features.columns([F.col(c) for c in inputs]), F.col(y).cast("double")])
    d = features.d
    left, slopes = partialled(m.cov, [d], list(range(d)), ridge)
    return Fit(features, tuple(inputs), y, m.mean[:d], slopes[:, 0], float(m.mean[d]), m.n, float(1 - left[0, 0] / m.cov[d, d]) if m.cov[d, d] > 0 else 0.0)


def noise_direction(df: DataFrame, x: str, y: str, d: int = 30, p: KernelTest = KernelTest(), ridge: float = 1e-6) -> DataFrame:
    """cause, effect, n, r2, statistic, p: in each order the effect by ridge on the cause's features, and how much its residual depends on the cause.

    Where noise is added to a nonlinear function of the cause, the residual depends on it in the wrong order only.
    """
    z = standardised(df.select(x, y), [x, y])
    out = None
    for cause, effect in ((x, y), (y, x)):
        fit = ridge_fit(z, effect, [cause], Cosines.drawn(1, d, p.seed + 7, p.width), ridge)
        rest = z.select(F.col(cause).alias("_c"), fit.residual().alias("_r"))
        test = kernel_test(rest, "_c", "_r", p=p)
        row = test.select(F.lit(cause).alias("cause"), F.lit(effect).alias("effect"), "n", F.lit(fit.r2).alias("r2"), "statistic", "p")
        out = row if out is None else out.unionByName(row)
    return out


def kernel_granger(df: DataFrame, own: Cosines, joint: Cosines, ridge: float = 1e-3, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """target, source, n, f_stat, p: whether features of both pasts foretell the target beyond those of its own past.

    Series are standardised in time; one aggregation yields the moments of every ordered pair, and
    each pair's row of moments is solved where it lies.
    """
    w = Window.partitionBy(series)
    s = df.select(F.col(series).alias("series"), F.col(t).alias("t"), ((F.col(v) - F.avg(v).over(w)) / F.coalesce(F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)), F.lit(1.0))).alias("v"))
    o = Window.partitionBy("series").orderBy("t")
    e = s.select("series", "t", F.col("v").alias("past"), F.lead("v").over(o).alias("next"), F.lead("t").over(o).alias("t2")).filter(F.col("t2") == F.col("t") + 1)
    x = e.select(F.col("series").alias("target"), "t", F.col("past").alias("xp"), F.col("next").alias("xf"))
    y = e.select(F.col("series").alias("source"), "t", F.col("past").alias("yp"))
    names = [f"f{i}" for i in range(own.d + joint.d)] + ["xf"]
    features = [*own.columns([F.col("xp")]), *joint.columns([F.col("xp"), F.col("yp")])]
    rows = x.join(y, "t").filter("target != source").select("target", "source", *[c.alias(n) for c, n in zip(features, names, strict=False)], "xf")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = rows.groupBy("target", "source").agg(F.count("*").alias("n"), *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])
    k, q = len(names) - 1, joint.d

    def run(it):
        for pdf in it:
            found = []
            for r in pdf.to_dict("records"):
                cov = np.zeros((k + 1, k + 1))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
                less = partialled(cov, [k], list(range(own.d)), ridge)[0][0, 0]
                more = partialled(cov, [k], list(range(k)), ridge)[0][0, 0]
                f = (less - more) / q / (more / (r["n"] - k - 1)) if r["n"] > k + 1 and more > 0 else None
                found.append((r["target"], r["source"], r["n"], f, None if f is None else f_sf(f, q, r["n"] - k - 1)))
            yield pdf.__class__(found, columns=["target", "source", "n", "f_stat", "p"])

    return moments.mapInPandas(run, "target string, source string, n long, f_stat double, p double")


def sweep_sql(name: str, pivots: Sequence[int], by: Sequence[str] = ()) -> str:
    """SQL steps that regress on the pivots: from `name`_0 (by.., i, j, v) to `name`_k, the entries off the pivots partialled, those on one side of a pivot the slopes."""
    steps = []
    on = lambda t: "".join(f" AND {t}.{b} = a.{b}" for b in by)
    for s, k in enumerate(pivots):
        steps.append(
            f"{name}_{s + 1} AS MATERIALIZED (SELECT {''.join(f'a.{b}, ' for b in by)}a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN -1 / p.v WHEN a.i = {k} OR a.j = {k} THEN a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v "
            f"FROM {name}_{s} a JOIN {name}_{s} p ON p.i = {k} AND p.j = {k}{on('p')} JOIN {name}_{s} r ON r.i = a.i AND r.j = {k}{on('r')} JOIN {name}_{s} c ON c.i = {k} AND c.j = a.j{on('c')})"
        )
    return ",\n".join(steps)


def moments_sql(name: str, rows: str, columns: Sequence[str], ridge_on: Sequence[int], ridge: float, by: Sequence[str] = ()) -> str:
    """`name`_0 (by.., i, j, v): covariances of the columns of `rows`, with the ridge on some places of the diagonal."""
    keys = "".join(f"{b}, " for b in by)
    m = len(columns)
    entries = ", ".join(f"covar_pop({columns[min(i, j)]}, {columns[max(i, j)]})" + (f" + {ridge}" if i == j and i in ridge_on else "") for i in range(m) for j in range(m))
    return f"""{name}_w AS MATERIALIZED (SELECT {keys}[{entries}] AS v FROM {rows} {'GROUP BY ' + ', '.join(by) if by else ''}),
{name}_0 AS MATERIALIZED (SELECT {keys}(k // {m})::INT AS i, (k % {m})::INT AS j, v[k + 1] AS v FROM {name}_w, range({m * m}) AS q(k))"""
