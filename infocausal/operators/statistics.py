"""Sample and series statistics over long tables (series, t, v): one aggregation or one sort a series, or counts first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shape(df: DataFrame, series: str = "series", v: str = "v") -> DataFrame:
    """series, n, skewness, kurtosis (of the population, less 3): null where all values are equal."""
    c = df.withColumn("_d", F.col(v) - F.avg(v).over(Window.partitionBy(series)))
    m = c.groupBy(series).agg(F.count("*").alias("n"), *[F.avg(F.pow("_d", F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])
    m2 = F.nullif(F.col("m2"), F.lit(0.0))
    return m.select(series, "n", (F.col("m3") / F.pow(m2, F.lit(1.5))).alias("skewness"), (F.col("m4") / (m2 * m2) - 3).alias("kurtosis"))


def empirical_cdf(df: DataFrame, series: str = "series", v: str = "v") -> DataFrame:
    """series, v, cdf at every distinct value; equal values are counted before the running sum."""
    c = df.groupBy(series, v).agg(F.count("*").alias("n"))
    w = Window.partitionBy(series)
    return c.select(series, v, (F.sum("n").over(w.orderBy(v)) / F.sum("n").over(w)).alias("cdf"))


def two_samples(df: DataFrame, group: str, y: str) -> DataFrame:
    """n1, n0, u (Mann-Whitney, of group 1), z (with ties), ks (largest distance of the two distributions), auc.

    Rows are counted by value first; the running sums go over values, cut into ranges of equal
    counts, so no task orders the whole table.
    """
    g = F.col(group).cast("int")
    c = df.filter(F.col(y).isNotNull() & g.isNotNull()).groupBy(F.col(y).alias("y")).agg(F.sum(g).alias("k1"), F.sum(1 - g).alias("k0"))
    cuts = c.agg(F.percentile_approx("y", [i / 64 for i in range(1, 64)], 10_000).alias("cuts"))
    r = c.crossJoin(F.broadcast(cuts)).withColumn("r", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < F.col("y")))).drop("cuts")
    ranges = r.groupBy("r").agg(F.sum("k1").alias("s1"), F.sum("k0").alias("s0"))
    by_range = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # over 64 rows at most
    first = lambda s: F.coalesce(F.sum(s).over(by_range), F.lit(0))
    starts = ranges.select("r", first("s1").alias("b1"), first("s0").alias("b0"))
    w = Window.partitionBy("r").orderBy("y")
    totals = ranges.agg(F.sum("s1").alias("n1"), F.sum("s0").alias("n0"))
    x = r.join(F.broadcast(starts), "r").select("k1", "k0", (F.sum("k1").over(w) + F.col("b1")).alias("c1"), (F.sum("k0").over(w) + F.col("b0")).alias("c0"))
    t = F.col("k1") + F.col("k0")
    x = x.crossJoin(F.broadcast(totals)).agg(
        F.first("n1").alias("n1"), F.first("n0").alias("n0"), F.sum(F.col("k1") * (F.col("c0") - F.col("k0") + F.col("k0") / 2)).alias("u"),
        F.sum((t * t * t - t).cast("double")).alias("ties"), F.max(F.abs(F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0"))).alias("ks"),
    )
    n1, n0, n = F.col("n1"), F.col("n0"), F.col("n1") + F.col("n0")
    var = n1 * n0 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return x.select("n1", "n0", "u", ((F.col("u") - n1 * n0 / 2) / F.sqrt(var)).alias("z"), "ks", (F.col("u") / n1 / n0).alias("auc"))


def bin_counts(df: DataFrame, series: str = "series", v: str = "v") -> DataFrame:
    """series, sturges, rice, scott, freedman_diaconis: numbers of equal-width bins."""
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    s = df.groupBy(series).agg(F.count(v).alias("n"), (F.max(v) - F.min(v)).alias("span"), F.stddev_samp(v).alias("sd"), q.alias("q"))
    third = F.pow("n", F.lit(1 / 3))
    bins = lambda width: F.greatest(F.ceil(F.col("span") / F.nullif(width, F.lit(0.0))), F.lit(1)).cast("long")
    return s.select(
        series, (F.ceil(F.log2("n")) + 1).cast("long").alias("sturges"), F.ceil(2 * third).cast("long").alias("rice"),
        bins(3.49 * F.col("sd") / third).alias("scott"), bins(2 * (F.col("q")[1] - F.col("q")[0]) / third).alias("freedman_diaconis"),
    )


def quantile_bins(df: DataFrame, bins: int, series: str = "series", v: str = "v", out: str = "b") -> DataFrame:
    """The rows with a bin of about equal counts: how many of the series' inner quantiles are under v."""
    cuts = df.groupBy(series).agg(F.percentile(v, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"))
    return df.join(cuts, series).withColumn(out, F.size(F.filter("_cuts", lambda x: x < F.col(v)))).drop("_cuts")


def dickey_fuller(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, n, rho, statistic: the change on the level before, with a constant; very negative statistics speak against a unit root."""
    w = Window.partitionBy(series).orderBy(t)
    d = df.select(series, F.lag(v).over(w).alias("x"), (F.col(v) - F.lag(v).over(w)).alias("y")).filter("x is not null")
    m = d.groupBy(series).agg(F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    rho = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    rest = (F.col("yy") - rho * F.col("xy")) / (F.col("n") - 2)
    return m.filter("n > 2").select(series, "n", rho.alias("rho"), (rho / F.sqrt(F.nullif(rest, F.lit(0.0)) / F.col("xx"))).alias("statistic"))


def hurst(df: DataFrame, scales: tuple[int, ...] = (1, 2, 4, 8), series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, hurst: 1 + half the slope of the log variance of block means on the log block length."""
    w = Window.partitionBy(series).orderBy(t)
    i = df.select(series, v, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(series)).alias("n"))
    x = i.withColumn("k", F.explode(F.array(*map(F.lit, scales)))).filter("i < n - n % k")
    means = x.groupBy(series, "k", F.expr("i div k").alias("b")).agg(F.avg(v).alias("m"))
    var = means.groupBy(series, "k").agg(F.var_samp("m").alias("s")).filter("s > 0")
    return var.groupBy(series).agg((1 + F.regr_slope(F.log("s"), F.log(F.col("k").cast("double"))) / 2).alias("hurst"))


def regularity(df: DataFrame, m: int = 2, tolerance: float = 0.2, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, sample_entropy, approximate_entropy over windows of m and m + 1 values that differ by at most tolerance * sd everywhere.

    Windows meet in cells of their first value, one tolerance wide, each with its two neighbours; only
    pairs in such cells are compared.
    """
    w = Window.partitionBy(series).orderBy(t)
    s = df.groupBy(series).agg((F.stddev_pop(v) * tolerance).alias("_r"), F.count("*").alias("_n"))
    x = df.select(series, F.row_number().over(w).alias("i"), *[F.lead(v, k).over(w).alias(f"v{k}") for k in range(m + 1)])
    x = x.join(s, series).filter(F.col(f"v{m - 1}").isNotNull() & (F.col("_r") > 0)).withColumn("cell", F.floor(F.col("v0") / F.col("_r")))
    y = x.select(series, F.col("i").alias("j"), *[F.col(f"v{k}").alias(f"u{k}") for k in range(m + 1)], F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = x.join(y, [series, "cell"])
    for k in range(m):
        near = near.filter(F.abs(F.col(f"v{k}") - F.col(f"u{k}")) <= F.col("_r"))
    both = F.coalesce(F.abs(F.col(f"v{m}") - F.col(f"u{m}")) <= F.col("_r"), F.lit(False))
    ends = F.col(f"v{m}").isNotNull() & F.col(f"u{m}").isNotNull()
    per = near.groupBy(series, "i", "_n").agg(F.count("*").alias("c0"), F.sum(both.cast("long")).alias("c1"), F.sum((ends & (F.col("i") != F.col("j"))).cast("long")).alias("a0"))
    wide = F.col("_n") - m
    phi0 = F.sum(F.log(F.col("c0") / (wide + 1))) / F.first(wide + 1)
    phi1 = F.sum(F.when(F.col("c1") > 0, F.log(F.col("c1") / wide))) / F.first(wide)
    matches = F.sum(F.greatest(F.col("c1") - 1, F.lit(0)))
    return per.groupBy(series).agg(
        (-F.log(F.nullif(matches, F.lit(0)) / F.nullif(F.sum("a0"), F.lit(0)))).alias("sample_entropy"), (phi0 - phi1).alias("approximate_entropy")
    )


def phrases(symbols: list) -> int:
    """Phrases of the exhaustive parsing: each is the shortest that has not been seen in what stands before its last symbol."""
    text, n, at = "".join(map(chr, symbols)), 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text.find(text[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        n, at = n + 1, at + size
    return n


def lz_complexity(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, n, phrases, complexity (phrases log2(n) / n) of whether values are over their mean. The parsing is sequential: one task a series."""
    b = df.select(series, t, (F.col(v) > F.avg(v).over(Window.partitionBy(series))).cast("int").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({series: pdf[series].iloc[:1], "n": [len(pdf)], "phrases": [phrases(pdf.sort_values(t)["b"].tolist())]})

    out = b.groupBy(series).applyInPandas(run, f"{series} string, n long, phrases long")
    return out.withColumn("complexity", F.col("phrases") * F.log2("n") / F.col("n"))


def normalized_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """hx, hy, hxy, mi, nmi (by the root of the entropies), uncertainty (of x that y takes), variation (of information), total_correlation."""
    c = df.groupBy(x, y).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))

    def h(by: list[str], name: str) -> DataFrame:
        p = c.groupBy(*by).agg(F.sum("n").alias("n")) if len(by) == 1 else c
        p = p.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("t"))  # one row
        return p.agg((-F.sum(F.col("p") * F.log("p"))).alias(name))

    e = h([x], "hx").crossJoin(h([y], "hy")).crossJoin(h([x, y], "hxy"))
    mi = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0))
    e = e.withColumn("mi", mi)
    return e.select(
        "hx", "hy", "hxy", "mi", (F.col("mi") / F.nullif(F.sqrt(F.col("hx") * F.col("hy")), F.lit(0.0))).alias("nmi"),
        (F.col("mi") / F.nullif(F.col("hx"), F.lit(0.0))).alias("uncertainty"), (2 * F.col("hxy") - F.col("hx") - F.col("hy")).alias("variation"),
    )


def joint_distribution(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n, joint, x_given_y, y_given_x."""
    c = df.groupBy(x, y).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    of = lambda k: F.sum("n").over(Window.partitionBy(k))
    c = c.crossJoin(F.broadcast(total))  # one row
    return c.select(x, y, "n", (F.col("n") / F.col("t")).alias("joint"), (F.col("n") / of(y)).alias("x_given_y"), (F.col("n") / of(x)).alias("y_given_x"))


def downsampled(df: DataFrame, factor: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, t (of the coarse step), v (mean), n."""
    return df.groupBy(series, F.floor(F.col(t) / factor).cast("long").alias(t)).agg(F.avg(v).alias(v), F.count("*").alias("n"))


def windowed_granger(df: DataFrame, width: int, step: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """win, target, source, n, f_stat: Granger with one lag in windows of `width` steps every `step`; a transition joins its windows as rows of moments."""
    w = Window.partitionBy(series).orderBy(t)
    e = df.select(series, t, F.col(v).alias("past"), F.lead(v).over(w).alias("next"), F.lead(t).over(w).alias("t2")).filter(F.col("t2") == F.col(t) + 1)
    x = e.select(F.col(series).alias("target"), t, F.col("past").alias("x"), F.col("next").alias("y"))
    z = e.select(F.col(series).alias("source"), t, F.col("past").alias("z"))
    last = F.floor(F.col(t) / step)
    wins = F.explode(F.sequence(F.ceil((F.col(t) - width + 1) / step), last)).alias("win")
    m = x.join(z, t).filter("target != source").select("target", "source", "x", "y", "z", wins).groupBy("win", "target", "source").agg(
        F.count("*").alias("n"), *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "zz", "yy", "xz", "xy", "zy")]
    )
    or_null = lambda c: F.nullif(c, F.lit(0.0))
    det = or_null(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"))
    b1 = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det
    b2 = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    full = F.col("yy") - b1 * F.col("xy") - b2 * F.col("zy")
    own = F.col("yy") - F.col("xy") * F.col("xy") / or_null(F.col("xx"))
    return m.select(F.col("win").cast("long").alias("win"), "target", "source", "n", F.when(F.col("n") > 3, (own - full) / or_null(full) * (F.col("n") - 3)).alias("f_stat"))


def change_points(windows: DataFrame, threshold: float, value: str = "f_stat") -> DataFrame:
    """target, source, win, jump: windows whose value differs from the one before by more than `threshold` standard deviations of the jumps."""
    by = Window.partitionBy("target", "source")
    j = windows.select("target", "source", "win", (F.col(value) - F.lag(value).over(by.orderBy("win"))).alias("jump"))
    j = j.withColumn("_sd", F.stddev_samp("jump").over(by))
    return j.filter(F.abs("jump") > threshold * F.col("_sd")).drop("_sd")
