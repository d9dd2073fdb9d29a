"""Spectra by overlapping tapered segments, and densities on a grid, as aggregations over long series (series, t, v).

A value goes to the segments that cover its time; no series is put in order or gathered. Missing
times count as the segment's mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.scratch import materialize

#: Weights of cos(0), cos(2 pi x) and cos(4 pi x) of the common tapers, x from 0 to 1 over the segment.
TAPERS = {"boxcar": (1.0, 0.0, 0.0), "hann": (0.5, -0.5, 0.0), "hamming": (0.54, -0.46, 0.0), "blackman": (0.42, -0.5, 0.08)}


def taper(kind: str, at: Column, length: int) -> Column:
    a, b, c = TAPERS[kind]
    x = at * (2 * math.pi / (length - 1))
    return F.lit(a) + b * F.cos(x) + c * F.cos(2 * x)


def taper_power(kind: str, length: int) -> float:
    a, b, c = TAPERS[kind]
    return sum((a + b * math.cos(x) + c * math.cos(2 * x)) ** 2 for x in (2 * math.pi * i / (length - 1) for i in range(length)))


def welch(df: DataFrame, length: int = 64, step: int | None = None, kinds: Sequence[str] = ("hann",), series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """taper, series, k, frequency (k / length), segments, power: the mean over whole segments of the one-sided density.

    Each tapered value is spread over the frequencies and summed as cosine and sine by segment.
    """
    step = step or length // 2
    span = df.groupBy(series).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    x = df.select(F.col(series), F.col(t), F.col(v).cast("double").alias("_v")).na.drop().join(span, series)
    at = F.col(t) - F.col("_lo")
    last = F.floor((F.col("_hi") - F.col("_lo") + 1 - length) / step)  # of the whole segments
    first = F.greatest(F.floor((at - length) / step) + 1, F.lit(0))
    x = x.select(series, "_v", at.alias("_at"), first.alias("_a"), F.least(F.floor(at / step), last).alias("_b")).filter("_a <= _b")
    x = x.select(series, "_v", "_at", F.explode(F.sequence("_a", "_b")).alias("segment")).withColumn("_i", F.col("_at") - F.col("segment") * step)
    mean = x.groupBy(series, "segment").agg(F.avg("_v").alias("_m"))
    x = x.join(mean, [series, "segment"]).select(series, "segment", "_i", (F.col("_v") - F.col("_m")).alias("_d"))
    x = x.select(series, "segment", "_i", F.explode(F.array(*[F.struct(F.lit(k).alias("taper"), (F.col("_d") * taper(k, F.col("_i"), length)).alias("w")) for k in kinds])).alias("_x"))
    x = x.select(series, "segment", "_i", "_x.*", F.explode(F.sequence(F.lit(0), F.lit(length // 2))).alias("k"))
    angle = F.col("_i") * F.col("k") * (2 * math.pi / length)
    s = x.groupBy("taper", series, "segment", "k").agg(F.sum(F.col("w") * F.cos(angle)).alias("c"), F.sum(F.col("w") * F.sin(angle)).alias("s"))
    power = (F.col("c") * F.col("c") + F.col("s") * F.col("s")) * F.when((F.col("k") == 0) | (2 * F.col("k") == length), 1.0).otherwise(2.0)
    whole = F.element_at(F.create_map(*[F.lit(y) for k in kinds for y in (k, taper_power(k, length))]), F.col("taper"))
    out = s.groupBy("taper", series, "k").agg(F.count("*").alias("segments"), F.avg(power).alias("p"))
    return out.select("taper", series, "k", (F.col("k") / length).alias("frequency"), "segments", (F.col("p") / whole).alias("power"))


# ---------------------------------------------------------------- densities


def _gridded(df: DataFrame, cells: int, by: list[str], columns: list[str]) -> DataFrame:
    """by, g0, g1 .. (grid points), w: each value's weight goes to its two neighbours on a grid over its range, three widths wider; h<i>, d<i>: width and step."""
    x = df.select(*by, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    s = x.groupBy(*by).agg(F.count("*").alias("n"), *[f(F.col(f"x{i}")).alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))])
    power = -1.0 / (4 + len(columns))
    for i in range(len(columns)):
        s = s.withColumn(f"h{i}", 1.06 * F.col(f"sd{i}") * F.pow(F.col("n").cast("double"), F.lit(power)))
        s = s.withColumn(f"d{i}", (F.col(f"hi{i}") - F.col(f"lo{i}") + 6 * F.col(f"h{i}")) / (cells - 1))
    # Written, so that the planner knows a row a group and sends it to the rows; by their groups' few keys the rows would meet in few tasks.
    j = x.join(materialize(s, "widths"), by) if by else x.crossJoin(F.broadcast(s))  # one row
    j = j.filter(" and ".join(f"h{i} > 0" for i in range(len(columns))))
    weight = F.lit(1.0)
    for i in range(len(columns)):
        at = (F.col(f"x{i}") - F.col(f"lo{i}") + 3 * F.col(f"h{i}")) / F.col(f"d{i}")
        j = j.withColumn("_f", F.floor(at)).withColumn("_r", at - F.floor(at))
        j = j.withColumn("_g", F.explode(F.array(F.struct(F.col("_f").alias("g"), (1 - F.col("_r")).alias("w")), F.struct((F.col("_f") + 1).alias("g"), F.col("_r").alias("w")))))
        j = j.withColumn(f"g{i}", F.col("_g.g")).withColumn(f"w{i}", F.col("_g.w"))
        weight = weight * F.col(f"w{i}")
    stats = ["n", *[f"{k}{i}" for i in range(len(columns)) for k in "hd"]]
    keys = [*by, *[f"g{i}" for i in range(len(columns))]]
    return materialize(j.groupBy(*keys).agg(F.sum(weight).alias("w"), *[F.first(c).alias(c) for c in stats]).filter("w > 0"), "cells")


def _smoothed(cells: DataFrame, at: str, h: str, d: str, by: list[str], w: str = "w") -> DataFrame:
    """The cells with `w` replaced by its Gaussian average along one axis, over the axis' own cells; a join of grid points, whatever the rows were."""
    a = cells.select(*by, F.col(at).alias("_to")).distinct()
    j = cells.join(a, by) if by else cells.crossJoin(a)
    z = (F.col("_to") - F.col(at)) * F.col(d) / F.col(h)
    kernel = F.exp(-0.5 * z * z) / (F.col(h) * math.sqrt(2 * math.pi))
    rest = [c for c in cells.columns if c not in (*by, at, w) and not c.startswith("g")]
    others = [c for c in cells.columns if c.startswith("g") and c != at and c not in by]
    out = j.groupBy(*by, *others, "_to").agg(F.sum(F.col(w) * kernel).alias(w), *[F.first(c).alias(c) for c in rest])
    return out.withColumnRenamed("_to", at)


def kernel_entropy(df: DataFrame, v: str, cells: int = 128, by: Sequence[str] = ("series",)) -> DataFrame:
    """by, n, h: the mean of -log density at the values, with a Gaussian kernel of Silverman's width; values are dealt linearly to grid points first.

    A value between two points is off by at most half a step's square over eight times the second
    derivative of the kernel, so the density is off by at most (step / width)^2 / 8 * 0.4 / width.
    """
    by = list(by)
    c = _gridded(df, cells, by, [v])
    f = _smoothed(c, "g0", "h0", "d0", by).select(*by, "g0", (F.col("w") / F.col("n")).alias("f"))
    j = c.join(f, [*by, "g0"])
    return j.groupBy(*by).agg(F.first("n").alias("n"), F.sum(-F.col("w") / F.col("n") * F.log("f")).alias("h"))


def kernel_information(df: DataFrame, x: str, y: str, cells: int = 32, by: Sequence[str] = ()) -> DataFrame:
    """by, n, mi: the mean of log f(x, y) / (f(x) f(y)), the densities by product kernels on a common grid, smoothed along one axis after the other."""
    by = list(by)
    c = _gridded(df, cells, by, [x, y])
    joint = _smoothed(_smoothed(c, "g0", "h0", "d0", by), "g1", "h1", "d1", by).select(*by, "g0", "g1", (F.col("w") / F.col("n")).alias("f"))
    side = lambda i: _smoothed(c.groupBy(*by, f"g{i}").agg(F.sum("w").alias("w"), *[F.first(k).alias(k) for k in ("n", f"h{i}", f"d{i}")]), f"g{i}", f"h{i}", f"d{i}", by).select(*by, f"g{i}", (F.col("w") / F.col("n")).alias(f"f{i}"))
    j = c.join(joint, [*by, "g0", "g1"]).join(side(0), [*by, "g0"]).join(side(1), [*by, "g1"])
    return j.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("w") / F.col("n") * F.log(F.col("f") / (F.col("f0") * F.col("f1")))).alias("mi"))
