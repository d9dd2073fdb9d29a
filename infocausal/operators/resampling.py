"""Surrogates, bootstraps and intervals. Draws come from an MD5 of the names of what is drawn, so a replicate is the
same on every run and partitioning, and any engine can make it again; series are replicated by joins, not in memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(*of: Column | str) -> Column:
    """A whole number from 0 to 2^32 - 1 that the columns decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in of])), 1, 8), 16, 10).cast("long")


def _placed(df: DataFrame, series: str, t: str, v: str) -> DataFrame:
    w = Window.partitionBy(series)
    return df.select(series, F.col(v).alias("v"), (F.row_number().over(w.orderBy(t)) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))


def block_bootstrap(df: DataFrame, replicates: int, block: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, rep, i, v: blocks of `block` values from drawn places (cyclic), one after another, as long as the series."""
    x = _placed(df, series, t, v)
    blocks = x.select(series, "n").distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))))
    start = draw(series, "rep", "j") % F.col("n")
    at = blocks.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    i = (F.col("j") * block + F.col("k")).cast("long")
    at = at.select(series, "rep", i.alias("to"), ((F.col("start") + F.col("k")) % F.col("n")).alias("i")).join(x, [series, "i"]).filter("to < n")
    return at.select(series, "rep", F.col("to").alias("i"), "v")


def stationary_bootstrap(df: DataFrame, replicates: int, mean_block: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """As block_bootstrap, with blocks of random length: at each place a new block begins with the chance 1 / mean_block."""
    x = _placed(df, series, t, v)
    at = x.select(series, "i", "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    new = (F.col("i") == 0) | (draw(series, "rep", "i", F.lit("new")) % mean_block == 0)
    place = draw(series, "rep", "i", F.lit("from")) % F.col("n")
    w = Window.partitionBy(series, "rep").orderBy("i")
    last = F.last(F.when(new, F.struct(F.col("i").alias("i"), place.alias("p"))), True).over(w)
    at = at.withColumn("b", last).select(series, "rep", F.col("i").alias("to"), ((F.col("b.p") + F.col("i") - F.col("b.i")) % F.col("n")).alias("i"))
    return at.join(x, [series, "i"]).select(series, "rep", F.col("to").alias("i"), "v")


def shuffled(df: DataFrame, replicates: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, rep, i, v: the values in an order that the draws decide; all structure in time is gone, the distribution stays."""
    x = _placed(df, series, t, v).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy(series, "rep").orderBy(draw(series, "rep", "i"), "i")
    return x.select(series, "rep", (F.row_number().over(w) - 1).cast("long").alias("i"), "v")


def shifted(df: DataFrame, replicates: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, rep, i, v: the series turned round by a drawn number of places."""
    x = _placed(df, series, t, v).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return x.select(series, "rep", ((F.col("i") + draw(series, "rep")) % F.col("n")).alias("i"), "v")


def fourier_surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Values with the spectrum of x and random phases."""
    f = np.fft.rfft(x)
    phase = rng.uniform(0, 2 * np.pi, len(f))
    phase[0] = 0
    if len(x) % 2 == 0:
        phase[-1] = 0
    return np.fft.irfft(f * np.exp(1j * phase), len(x))


def amplitude_adjusted(x: np.ndarray, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """The values of x in an order whose spectrum is close to that of x: spectrum and ranks are restored by turns."""
    sorted_x, amplitude, order = np.sort(x), np.abs(np.fft.rfft(x)), None
    y = rng.permutation(x)
    for _ in range(rounds):
        f = np.fft.rfft(y)
        rank = np.argsort(np.argsort(np.fft.irfft(amplitude * np.exp(1j * np.angle(f)), len(x)), kind="stable"), kind="stable")
        y = sorted_x[rank]
        if order is not None and (rank == order).all():
            break
        order = rank
    return y


def spectral_surrogates(df: DataFrame, replicates: int, adjusted: bool, series: str = "series", t: str = "t", v: str = "v", seed: int = 42) -> DataFrame:
    """series, rep, i, v: Fourier surrogates, amplitude adjusted or not. Spark deals out series and replicates; a transform needs a whole series."""
    make = amplitude_adjusted if adjusted else fourier_surrogate

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["v"].to_numpy(float)
        rng = np.random.default_rng([seed, *str(key[0]).encode(), int(key[1])])
        return pd.DataFrame({series: key[0], "rep": key[1], "i": np.arange(len(x)), "v": make(x, rng)})

    x = _placed(df, series, t, v).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    kind = x.schema[series].dataType.simpleString()
    return x.groupBy(series, "rep").applyInPandas(run, f"{series} {kind}, rep int, i long, v double")


def percentile_interval(replicates: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by.., low, high, se, n: of the replicates' values."""
    side = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(side), F.lit(1 - side)))
    s = replicates.groupBy(*by).agg(q.alias("q"), F.stddev_samp(value).alias("se"), F.count(value).alias("n"))
    return s.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "se", "n")


def jackknife_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by.., mean, se, acceleration: leaving each row out in turn; for the mean that is a function of three moments."""
    w = Window.partitionBy(*by)
    d = df.select(*by, F.col(value).alias("v"), (F.col(value) - F.avg(value).over(w)).alias("d"))
    m = d.groupBy(*by).agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.sum(F.col("d") * F.col("d") * F.col("d")).alias("s3"))
    return m.select(*by, "mean", F.sqrt(F.col("s2") / (F.col("n") * (F.col("n") - 1))).alias("se"), (F.col("s3") / (6 * F.pow(F.nullif(F.col("s2"), F.lit(0.0)), F.lit(1.5)))).alias("acceleration"))


def corrected_interval(replicates: DataFrame, estimate: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by.., low, high: percentiles moved for bias and acceleration (BCa). estimate: by.., mean, acceleration as jackknife_mean gives them.

    The replicates of one statistic are few hundred numbers, so each group is one array.
    """
    from statistics import NormalDist

    normal, z = NormalDist(), NormalDist().inv_cdf((1 + level) / 2)

    @F.pandas_udf("struct<low:double,high:double>")
    def ends(values: pd.Series, mean: pd.Series, a: pd.Series) -> pd.DataFrame:
        out = []
        for v, m, c in zip(values, mean, a, strict=True):
            v = np.sort(np.asarray(v, float))
            c = 0.0 if c is None or np.isnan(c) else c
            share = ((v < m).sum() + 0.5 * (v == m).sum()) / len(v)
            z0 = normal.inv_cdf(min(max(share, 0.5 / len(v)), 1 - 0.5 / len(v)))
            out.append([float(np.quantile(v, normal.cdf(z0 + (z0 + s) / (1 - c * (z0 + s))))) for s in (-z, z)])
        return pd.DataFrame(out, columns=["low", "high"])

    g = replicates.groupBy(*by).agg(F.collect_list(value).alias("_v")).join(estimate.select(*by, "mean", "acceleration"), by)
    return g.withColumn("e", ends("_v", "mean", "acceleration")).select(*by, "e.low", "e.high")


def permutation_p(observed: DataFrame, surrogates: DataFrame, by: list[str], value: str) -> DataFrame:
    """by.., observed, mean, z, p (one-sided, with one added), corrected (observed less the surrogates' mean)."""
    o = observed.select(*by, F.col(value).alias("observed"))
    s = surrogates.join(o, by).groupBy(*by, "observed").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sum((F.col(value) >= F.col("observed")).cast("long")).alias("k"), F.count(value).alias("n")
    )
    gap = F.col("observed") - F.col("mean")
    return s.select(*by, "observed", "mean", (gap / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"), ((F.col("k") + 1) / (F.col("n") + 1)).alias("p"), gap.alias("corrected"))
