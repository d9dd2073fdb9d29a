"""Entropies, mutual information and transfer entropy of discrete or binned states, in nats.

All estimators are plug-in: counts by group, marginals as window sums over the counts. The raw
rows are aggregated before any window, so windows see one row per joint state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equal_width_bins(df: DataFrame, value: str, bins: int, by: list[str], out: str = "b") -> DataFrame:
    """Column `out`: bin 0 to bins - 1 between the group's least and largest value; 0 where they are equal."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    b = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias(out)
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row of ends
    return joined.select(*df.columns, b)


def entropy_of_counts(counts: DataFrame, n: str, by: list[str]) -> DataFrame:
    """Shannon entropy of the states whose counts are the rows."""
    total = F.sum(n).over(Window.partitionBy(*by))
    p = counts.select(*by, (F.col(n) / total).alias("p"))
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))


def state_entropy(df: DataFrame, states: list[str], by: list[str]) -> DataFrame:
    return entropy_of_counts(df.groupBy(*by, *states).agg(F.count("*").alias("n")), "n", by)


def renyi(p: Column, alpha: float) -> Column:
    """Of a column of probabilities, as an aggregate; alpha 1 is Shannon's."""
    if alpha == 1:
        return -F.sum(F.when(p > 0, p * F.log(p)))
    return F.log(F.sum(F.when(p > 0, F.pow(p, F.lit(float(alpha)))))) / (1 - alpha)


def tsallis(p: Column, q: float) -> Column:
    if q == 1:
        return renyi(p, 1)
    return (1 - F.sum(F.when(p > 0, F.pow(p, F.lit(float(q)))))) / (q - 1)


def mutual_information(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by..., mi (not under 0)."""
    c = df.groupBy(*by, x, y).agg(F.count("*").alias("n"))
    of = lambda *cols: F.sum("n").over(Window.partitionBy(*by, *cols))
    c = c.select(*by, "n", of().alias("t"), of(x).alias("nx"), of(y).alias("ny"))
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    return c.groupBy(*by).agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def conditional_information(df: DataFrame, x: str, y: str, z: list[str], by: list[str], out: str = "te") -> DataFrame:
    """by..., n_obs, I(x; y | z). With x a future, z its past and y a source's past this is transfer entropy."""
    c = df.groupBy(*by, x, y, *z).agg(F.count("*").alias("n"))
    of = lambda *cols: F.sum("n").over(Window.partitionBy(*by, *cols))
    c = c.select(*by, "n", of().alias("t"), of(*z).alias("nz"), of(x, *z).alias("nxz"), of(y, *z).alias("nyz"))
    info = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz"))))
    return c.groupBy(*by).agg(F.sum("n").alias("n_obs"), F.greatest(info, F.lit(0.0)).alias(out))


def embedded(binned: DataFrame, series: str, t: str, b: str, by: list[str] | None = None) -> DataFrame:
    """by..., series, t, past, future: neighbours in time only, so a gap gives no transition."""
    w = Window.partitionBy(*(by or []), series).orderBy(t)
    e = binned.select(*(by or []), series, t, F.col(b).alias("past"), F.lead(b).over(w).alias("future"), F.lead(t).over(w).alias("_t"))
    return e.filter(F.col("_t") == F.col(t) + 1).drop("_t")


def transfer_entropy_pairs(e: DataFrame, series: str, t: str, by: list[str] | None = None) -> DataFrame:
    """target, source, n_obs, te for all ordered pairs of series; they join on time, once."""
    by = by or []
    x = e.select(*by, F.col(series).alias("target"), t, F.col("past").alias("xp"), F.col("future").alias("xf"))
    y = e.select(*by, F.col(series).alias("source"), t, F.col("past").alias("yp"))
    pairs = x.join(y, [*by, t]).filter("target != source")
    return conditional_information(pairs, "xf", "yp", ["xp"], [*by, "target", "source"])


def ordinal_pattern(value: str, order: int, w) -> Column:
    """The ranks of `order` values in a row as digits, ties by place; null at the end."""
    v = [F.lead(value, i).over(w) for i in range(order)]
    digits = []
    for i in range(order):
        smaller = [((v[j] < v[i]) | ((v[j] == v[i]) & F.lit(j < i))).cast("int") for j in range(order) if j != i]
        rank = smaller[0]
        for s in smaller[1:]:
            rank = rank + s
        digits.append(rank)
    code = digits[0]
    for d in digits[1:]:
        code = code * order + d
    return F.when(v[-1].isNotNull(), code)


def partial_information(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """Redundancy (least specific information, weighted), unique parts and synergy of two sources."""
    c = df.groupBy(target, a, b).agg(F.count("*").alias("n"))
    of = lambda *cols: F.sum("n").over(Window.partitionBy(*cols))
    total = F.sum("n").over(Window.partitionBy())
    c = c.select(
        target, a, b, "n", total.alias("t"), of(target).alias("nt"), of(a).alias("na"), of(b).alias("nb"),
        of(target, a).alias("nta"), of(target, b).alias("ntb"), of(a, b).alias("nab"),
    )
    n, t = F.col("n"), F.col("t")
    part = lambda joint, own: n / t * F.log(F.col(joint) * t / (F.col("nt") * F.col(own)))
    per = c.groupBy(target).agg(
        F.sum(part("nta", "na")).alias("ia"), F.sum(part("ntb", "nb")).alias("ib"),
        F.sum(n / t * F.log(n * t / (F.col("nt") * F.col("nab")))).alias("iab"),
    )
    whole = per.agg(
        F.sum("ia").alias("mi_a"), F.sum("ib").alias("mi_b"), F.sum("iab").alias("mi_ab"), F.sum(F.least("ia", "ib")).alias("redundancy")
    )
    return whole.select(
        "mi_a", "mi_b", "mi_ab", "redundancy",
        (F.col("mi_a") - F.col("redundancy")).alias("unique_a"), (F.col("mi_b") - F.col("redundancy")).alias("unique_b"),
        (F.col("mi_ab") - F.col("mi_a") - F.col("mi_b") + F.col("redundancy")).alias("synergy"),
    )
