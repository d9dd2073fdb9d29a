"""Time series in long form (series, t, v): every window is partitioned by series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(series: str, t: str):
    return Window.partitionBy(series).orderBy(t)


def centred(df: DataFrame, series: str = "series", v: str = "v") -> DataFrame:
    return df.withColumn("d", F.col(v) - F.avg(v).over(Window.partitionBy(series)))


def autocorrelation(df: DataFrame, lags: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, lag, acf for lags 1 to `lags`: a frame of lagged products, no self-join."""
    w = _w(series, t)
    x = centred(df, series, v).select(series, "d", *[F.lead("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = x.groupBy(series).agg(F.sum(F.col("d") * F.col("d")).alias("s"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"l{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"l{k}") / F.nullif(F.col("s"), F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)])
    return sums.select(series, F.explode(rows).alias("r")).select(series, "r.lag", "r.acf")


def cross_correlation(df: DataFrame, lag: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """x, y, ccf: x at t + lag against y at t, for all ordered pairs."""
    c = centred(df, series, v)
    norm = c.groupBy(series).agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    x = c.select(F.col(series).alias("x"), (F.col(t) - lag).alias(t), F.col("d").alias("dx"))
    y = c.select(F.col(series).alias("y"), t, F.col("d").alias("dy"))
    sums = x.join(y, t).filter("x != y").groupBy("x", "y").agg(F.sum(F.col("dx") * F.col("dy")).alias("p"))
    sx = norm.select(F.col(series).alias("x"), F.col("s").alias("sx"))
    sy = norm.select(F.col(series).alias("y"), F.col("s").alias("sy"))
    return sums.join(sx, "x").join(sy, "y").select("x", "y", (F.col("p") / F.sqrt(F.col("sx") * F.col("sy"))).alias("ccf"))


def moving_average(df: DataFrame, half: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """Centred mean over 2 half + 1 rows, fewer at the ends."""
    return df.withColumn("ma", F.avg(v).over(_w(series, t).rowsBetween(-half, half)))


def sliding_stats(df: DataFrame, width: int, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, t (of the first row), mean, var of each full window of `width` rows."""
    w = _w(series, t).rowsBetween(0, width - 1)
    out = df.select(series, t, F.avg(v).over(w).alias("mean"), F.var_samp(v).over(w).alias("var"), F.count(v).over(w).alias("_n"))
    return out.filter(F.col("_n") == width).drop("_n")


def cusum(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """Largest absolute running sum of the standardised deviations, over the root of n."""
    c = centred(df, series, v)
    sd = F.stddev_samp(v).over(Window.partitionBy(series))
    run = c.select(series, (F.sum("d").over(_w(series, t)) / F.nullif(sd, F.lit(0.0))).alias("c"))
    return run.groupBy(series).agg((F.max(F.abs("c")) / F.sqrt(F.count("*"))).alias("cusum"))


def shape_stats(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, rms, zero_crossings (of the centred series), slope, durbin_watson, kpss, activity, mobility, complexity."""
    w = _w(series, t)
    c = centred(df, series, v).withColumn("i", F.row_number().over(w) - 1)
    c = c.withColumn("d1", F.lead(v).over(w) - F.col(v)).withColumn("d2", F.lead("d1").over(w) - F.col("d1"))
    c = c.withColumn("before", F.lag("d").over(w)).withColumn("cum", F.sum("d").over(w))
    s = c.groupBy(series).agg(
        F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"),
        F.sum(((F.col("d") >= 0) != (F.col("before") >= 0)).cast("long")).alias("zero_crossings"),
        F.regr_slope(F.col(v), F.col("i").cast("double")).alias("slope"),
        (F.sum(F.pow(F.col("d") - F.col("before"), F.lit(2.0))) / F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0))).alias("durbin_watson"),
        (F.sum(F.col("cum") * F.col("cum")) / F.nullif(F.pow(F.count("*").cast("double"), F.lit(2.0)) * F.var_pop(v), F.lit(0.0))).alias("kpss"),
        F.var_pop(v).alias("v0"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2"),
    )
    mobility = F.sqrt(F.col("v1") / F.nullif(F.col("v0"), F.lit(0.0)))
    return s.select(
        series, "rms", "zero_crossings", "slope", "durbin_watson", "kpss", F.col("v0").alias("activity"), mobility.alias("mobility"),
        (F.sqrt(F.col("v2") / F.nullif(F.col("v1"), F.lit(0.0))) / mobility).alias("complexity"),
    )


def detrended(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """v less slope times place; the level stays."""
    x = df.withColumn("i", (F.row_number().over(_w(series, t)) - 1).cast("double"))
    slope = x.groupBy(series).agg(F.regr_slope(F.col(v), F.col("i")).alias("slope"))
    return x.join(slope, series).select(series, t, (F.col(v) - F.col("slope") * F.col("i")).alias("v"))


def granger_lag1(df: DataFrame, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """target, source, n, f_stat: target on its own past, with and without the source's past.

    Both regressions come from one pass of centred moments, so the data are joined once by time.
    """
    w = _w(series, t)
    e = df.select(series, t, F.col(v).alias("past"), F.lead(v).over(w).alias("next"), F.lead(t).over(w).alias("t2")).filter(F.col("t2") == F.col(t) + 1)
    x = e.select(F.col(series).alias("target"), t, F.col("past").alias("x"), F.col("next").alias("y"))
    z = e.select(F.col(series).alias("source"), t, F.col("past").alias("z"))
    m = x.join(z, t).filter("target != source").groupBy("target", "source").agg(
        F.count("*").alias("n"), *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "zz", "yy", "xz", "xy", "zy")]
    )
    or_null = lambda c: F.nullif(c, F.lit(0.0))
    det = or_null(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"))
    b1 = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det
    b2 = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    full = F.col("yy") - b1 * F.col("xy") - b2 * F.col("zy")
    own = F.col("yy") - F.col("xy") * F.col("xy") / or_null(F.col("xx"))
    f = F.when(F.col("n") > 3, (own - full) / or_null(full) * (F.col("n") - 3))
    return m.select("target", "source", "n", f.alias("f_stat"))
