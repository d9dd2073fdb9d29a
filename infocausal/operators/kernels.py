"""Statistics that need a series as an array, a replicate or a kernel matrix.

Spark groups and shuffles by series pair or replicate; Arrow hands each group to numpy. A group is one
pair of series, whose distances are in memory for BLOCK steps at a time, or one replicate's moments.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.functions.special import digamma
from infocausal.operators import discovery, information
from infocausal.operators.dependence import Gram


def exponential_smoothing(df: DataFrame, alpha: float, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, t, s: s = alpha v + (1 - alpha) s, from the first value on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        return pdf.assign(s=pdf[v].ewm(alpha=alpha, adjust=False).mean())[[series, t, "s"]]

    return df.select(series, t, v).groupBy(series).applyInPandas(run, f"{series} string, {t} long, s double")


def _pairs(df: DataFrame, series: str, t: str, v: str) -> DataFrame:
    x = df.select(F.col(series).alias("x"), t, F.col(v).alias("vx"))
    y = df.select(F.col(series).alias("y"), t, F.col(v).alias("vy"))
    return x.join(y, t).filter("x < y")


#: Rows of a distance matrix that are in memory at a time.
BLOCK = 512


def ksg(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Nearest-neighbour mutual information (first estimator), maximum norm; BLOCK rows of distances at a time."""
    n = len(a)
    if n <= k:
        return 0.0
    psi, total = np.vectorize(digamma), 0.0
    sa, sb = np.sort(a), np.sort(b)
    for at in range(0, n, BLOCK):
        x, y = a[at : at + BLOCK], b[at : at + BLOCK]
        joint = np.maximum(np.abs(x[:, None] - a), np.abs(y[:, None] - b))
        joint[np.arange(len(x)), np.arange(at, at + len(x))] = np.inf
        eps = np.partition(joint, k - 1, axis=1)[:, k - 1]
        counts = [_closer(s, v, eps) for s, v in ((sa, x), (sb, y))]
        total += (psi(counts[0] + 1.0) + psi(counts[1] + 1.0)).sum()
    return float(max(digamma(k) + digamma(n) - total / n, 0.0))


def _closer(ordered: np.ndarray, v: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """For each value the others that are nearer than eps; the ends are looked at again, as a sum may round past them."""
    low, high = np.searchsorted(ordered, v - eps), np.searchsorted(ordered, v + eps, side="right")
    last = len(ordered) - 1
    for _ in range(2):
        low = np.where((low > 0) & (np.abs(v - ordered[np.maximum(low - 1, 0)]) < eps), low - 1, low)
        high = np.where((high <= last) & (np.abs(v - ordered[np.minimum(high, last)]) < eps), high + 1, high)
    while (off := (low < high) & (np.abs(v - ordered[np.minimum(low, last)]) >= eps)).any():
        low = low + off
    while (off := (low < high) & (np.abs(v - ordered[np.maximum(high - 1, 0)]) >= eps)).any():
        high = high - off
    return np.maximum(high - low - 1, 0)


def knn_information(df: DataFrame, k: int = 3, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = [((c - c.mean()) / (c.std() or 1)).to_numpy() for c in (pdf["vx"], pdf["vy"])]
        return pd.DataFrame({"x": pdf["x"].iloc[:1], "y": pdf["y"].iloc[:1], "mi": ksg(z[0], z[1], k)})

    return _pairs(df, series, t, v).groupBy("x", "y").applyInPandas(run, "x string, y string, mi double")


def median_distance(z: np.ndarray) -> float:
    """The median of the distances over 0 between values, 1 if there are none, without making the pairs: a search over distances that counts by sorted places."""
    z = np.sort(z)
    n = len(z)
    upto = lambda d: int((np.searchsorted(z, z + d, side="right") - np.arange(1, n + 1)).sum())
    zero = upto(0.0)
    some = n * (n - 1) // 2 - zero
    if some <= 0:
        return 1.0

    def ranked(k: int) -> float:
        low, high = 0, int(np.float64(z[-1] - z[0]).view(np.int64)) + 2
        while low < high:
            mid = (low + high) // 2
            if upto(np.int64(mid).view(np.float64)) >= zero + k:
                high = mid
            else:
                low = mid + 1
        return float(np.int64(low).view(np.float64))

    return (ranked((some + 1) // 2) + ranked(some // 2 + 1)) / 2


def hsic_statistic(a: np.ndarray, b: np.ndarray) -> float:
    """Biased estimate with Gaussian kernels at the median distance; BLOCK rows of the kernels at a time."""
    n, wa, wb = len(a), median_distance(a), median_distance(b)
    product, row_a, row_b = 0.0, [], []
    for at in range(0, n, BLOCK):
        ka, kb = (np.exp(-((v[at : at + BLOCK, None] - v) ** 2) / (2 * w * w)) for v, w in ((a, wa), (b, wb)))
        product += (ka * kb).sum()
        row_a.append(ka.sum(1))
        row_b.append(kb.sum(1))
    ra, rb = np.concatenate(row_a), np.concatenate(row_b)
    return float((product - 2 / n * (ra @ rb) + ra.sum() * rb.sum() / n**2) / n**2)


def hsic(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": pdf["x"].iloc[:1], "y": pdf["y"].iloc[:1], "hsic": hsic_statistic(pdf["vx"].to_numpy(), pdf["vy"].to_numpy())})

    return _pairs(df, series, t, v).groupBy("x", "y").applyInPandas(run, "x string, y string, hsic double")


def surrogate_te(binned: DataFrame, shifts: int, series: str = "series", t: str = "t", b: str = "b") -> DataFrame:
    """target, source, te, p: against sources shifted in time (cyclic by equal steps), all shifts in one plan."""
    e = information.embedded(binned, series, t, b)
    span = e.groupBy(series).agg(F.min(t).alias("lo"), (F.max(t) - F.min(t) + 1).alias("n"))
    y = e.join(span, series).select(F.col(series).alias("source"), F.col("past").alias("yp"), t, "lo", "n", F.explode(F.sequence(F.lit(0), F.lit(shifts))).alias("shift"))
    moved = F.col("lo") + F.pmod(F.col(t) - F.col("lo") + F.floor(F.col("n") * F.col("shift") / (shifts + 1)), F.col("n"))
    y = y.select("source", "yp", "shift", moved.alias(t))
    x = e.select(F.col(series).alias("target"), t, F.col("past").alias("xp"), F.col("future").alias("xf"))
    te = information.conditional_information(x.join(y, t).filter("target != source"), "xf", "yp", ["xp"], ["target", "source", "shift"])
    own = F.max(F.when(F.col("shift") == 0, F.col("te"))).alias("te")
    s = te.groupBy("target", "source").agg(own, F.collect_list(F.when(F.col("shift") > 0, F.col("te"))).alias("others")).filter("te is not null")
    beaten = F.size(F.filter("others", lambda o: o >= F.col("te")))
    return s.select("target", "source", "te", ((1 + beaten) / (1 + F.size("others"))).alias("p"))


def poisson_weight(*of) -> Column:
    """A Poisson(1) draw (0 to 5) that a hash of the columns decides: how often a bootstrap replicate takes a row."""
    u = (F.pmod(F.xxhash64(*of), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    return sum(((u > c).cast("int") for c in cuts[1:]), (u > cuts[0]).cast("int"))


def replicate_moments(df: DataFrame, columns: list[str], key: list[str], replicates: int) -> DataFrame:
    """rep, n, means m<i> and covariances c<i>_<j> of every bootstrap replicate; `key` names a row, so equal rows draw apart."""
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    draw = poisson_weight(*[f"_k{i}" for i in range(len(key))], "rep")
    r = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", draw).filter("w > 0")
    w, total = F.col("w"), F.sum("w")
    return r.groupBy("rep").agg(
        total.alias("n"), *[(F.sum(w * F.col(c)) / total).alias(f"m{i}") for i, c in enumerate(columns)],
        *[
            (F.sum(w * F.col(columns[i]) * F.col(columns[j])) / total - F.sum(w * F.col(columns[i])) * F.sum(w * F.col(columns[j])) / total / total).alias(f"c{i}_{j}")
            for i in range(len(columns)) for j in range(i, len(columns))
        ],
    )


def edge_stability(df: DataFrame, columns: list[str], key: list[str], replicates: int, alpha: float = 0.05) -> DataFrame:
    """a, b, shares of the replicates in whose constraint search the two stay adjacent, and in which a points to b or b to a."""

    def run(it):
        for pdf in it:
            out = []
            for x in pdf.to_dict("records"):
                gram = Gram.of_moments(columns, x)
                edges, sepset = discovery.skeleton(gram, alpha)
                arrows = discovery.oriented(columns, edges, sepset)
                for a, b in combinations(columns, 2):
                    there = frozenset((a, b)) in edges
                    out.append((a, b, float(there), float(there and (b, a) not in arrows), float(there and (a, b) not in arrows)))
            yield pd.DataFrame(out, columns=["a", "b", "hit", "out", "back"])

    hits = replicate_moments(df, columns, key, replicates).mapInPandas(run, "a string, b string, hit double, out double, back double")
    return hits.groupBy("a", "b").agg(F.avg("hit").alias("stability"), F.avg("out").alias("a_to_b"), F.avg("back").alias("b_to_a"))


def stable_graph(stability: DataFrame, expected_false: float) -> DataFrame:
    """The edges over the threshold that keeps the expected number of false ones in bound (stability selection).

    With q edges a replicate on average out of p possible ones: threshold = (1 + q^2 / (p * bound)) / 2, at most 1.
    """
    whole = stability.agg(F.sum("stability").alias("q"), F.count("*").alias("p"))
    cut = F.least(F.lit(1.0), (1 + F.col("q") * F.col("q") / (F.col("p") * expected_false)) / 2)
    return stability.crossJoin(whole.select(cut.alias("threshold"))).filter("stability >= threshold")


def knn_entropy(df: DataFrame, k: int = 3, series: str = "series", v: str = "v") -> DataFrame:
    """series, n, h: differential entropy from the distance of each value to its k-th nearest; values that coincide with k others have none and are left out of the mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.sort(pdf[v].to_numpy(float))
        n, h = len(z), None
        if n > k:
            # The k nearest of a sorted value are among the k before and the k after it.
            near = np.full((n, 2 * k), np.inf)
            for i in range(1, k + 1):
                near[i:, i - 1] = z[i:] - z[:-i]
                near[:-i, k + i - 1] = z[i:] - z[:-i]
            eps = np.partition(near, k - 1, axis=1)[:, k - 1]
            if (eps > 0).any():
                h = float(digamma(n) - digamma(k) + np.log(2) + np.log(eps[eps > 0]).mean())
        return pd.DataFrame({series: pdf[series].iloc[:1], "n": [n], "h": [h]})

    return df.select(series, v).groupBy(series).applyInPandas(run, f"{series} string, n long, h double")


def conditional_ksg(x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int) -> float:
    """Nearest-neighbour information of x and y given z, maximum norm; BLOCK rows of distances at a time."""
    n, psi, total = len(x), np.vectorize(digamma), 0.0
    if n <= k:
        return 0.0
    for at in range(0, n, BLOCK):
        dx, dy, dz = (np.abs(v[at : at + BLOCK, None] - v) for v in (x, y, z))
        joint = np.maximum(np.maximum(dx, dy), dz)
        joint[np.arange(len(joint)), np.arange(at, at + len(joint))] = np.inf
        eps = np.partition(joint, k - 1, axis=1)[:, k - 1 : k]
        counts = [(d < eps).sum(1) for d in (np.maximum(dx, dz), np.maximum(dy, dz), dz)]
        nxz, nyz, nz = (np.maximum(c, 1).astype(float) for c in counts)
        total += (psi(nxz) + psi(nyz) - psi(nz)).sum()
    return float(max(digamma(k) - total / n, 0.0))


def knn_transfer(df: DataFrame, k: int = 3, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """target, source, n, te: nearest-neighbour information of the target's next value and the source's present one, given the target's present."""
    w = Window.partitionBy(series).orderBy(t)
    e = df.select(series, t, F.col(v).alias("past"), F.lead(v).over(w).alias("next"), F.lead(t).over(w).alias("t2")).filter(F.col("t2") == F.col(t) + 1)
    x = e.select(F.col(series).alias("target"), t, F.col("past").alias("xp"), F.col("next").alias("xf"))
    y = e.select(F.col(series).alias("source"), t, F.col("past").alias("yp"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = [((c - c.mean()) / (c.std() or 1)).to_numpy() for c in (pdf["xf"], pdf["yp"], pdf["xp"])]
        return pd.DataFrame({"target": pdf["target"].iloc[:1], "source": pdf["source"].iloc[:1], "n": [len(pdf)], "te": [conditional_ksg(*z, k)]})

    return x.join(y, t).filter("target != source").groupBy("target", "source").applyInPandas(run, "target string, source string, n long, te double")
