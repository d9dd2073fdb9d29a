"""Neighbours in delay space of long series (series, t, v): embedding choice, serial dependence, transfer without near times.

Delay vectors are made by dealing each value to the times that need it, one shuffle and no ordered
pass; a time with a missing delay has no vector. Neighbours meet in grid cells. The nearest one is
looked for in cells of one width, and where none is as near as a cell is wide, in cells of twice
the width, until all have theirs; so a step compares what shares a neighbourhood only. Distances
are maxima over coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infocausal.scratch import materialize


def delays(df: DataFrame, shifts: dict[str, int], series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, t, <name> = v at t + shift for each name, where all are there. A time that comes twice keeps its largest value."""
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).cast("long").alias("s")) for n, s in shifts.items()])
    x = df.select(F.col(series).alias("series"), F.col(t).cast("long").alias("_t"), F.col(v).cast("double").alias("v")).na.drop()
    x = x.select("series", "_t", "v", F.explode(steps).alias("_x")).select("series", (F.col("_t") - F.col("_x.s")).alias("t"), F.col("_x.n").alias("_n"), "v")
    return x.groupBy("series", "t").agg(*[F.max(F.when(F.col("_n") == n, F.col("v"))).alias(n) for n in shifts]).na.drop()


def _distance(names: Sequence[str], other: str = "_o") -> Column:
    parts = [F.abs(F.col(n) - F.col(f"{other}.{n}")) for n in names]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def nearest(points: DataFrame, names: Sequence[str], exclude: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """series, t, t2, d and <carry>, <carry>2: the nearest other point of the series by the named coordinates that is over `exclude` steps away, the earliest of equals.

    Points that have no such other point are left out.
    """
    axes = list(names[:2])
    span = points.groupBy("series").agg(F.count("*").alias("_c"), F.max(F.greatest(*[F.lit(0.0)] + [F.abs(F.col(a)) for a in axes])).alias("_m"))
    width = F.greatest(4 * F.col("_m") / F.pow(F.col("_c").cast("double"), F.lit(1.0 / len(axes))), F.lit(1e-9))
    p = materialize(points.select("series", "t", *dict.fromkeys([*names, *carry])).join(span.select("series", width.alias("_w"), "_m"), "series"), "points")
    own = [*dict.fromkeys([*names, *carry])]
    todo, found, scale = p, None, 1.0
    while not todo.isEmpty():
        cell = [F.floor(F.col(a) / (F.col("_w") * scale)).alias(f"_k{i}") for i, a in enumerate(axes)]
        held = p.select("series", *cell, F.struct(F.col("t").alias("t"), *own).alias("_o"))
        asked = todo.select("series", "t", *own, "_w", "_m", *cell)
        for i in range(len(axes)):
            asked = asked.withColumn(f"_k{i}", F.explode(F.array(*[F.col(f"_k{i}") + s for s in (-1, 0, 1)])))
        pairs = asked.join(held, ["series", *[f"_k{i}" for i in range(len(axes))]]).filter(F.abs(F.col("t") - F.col("_o.t")) > exclude)
        best = pairs.groupBy("series", "t").agg(F.min(F.struct(_distance(names).alias("d"), F.col("_o.t").alias("t2"), *[F.col(f"_o.{c}").alias(f"{c}2") for c in carry])).alias("_b"))
        # What is farther than a cell is wide may have a nearer one outside; the widest cells hold all.
        step = materialize(todo.join(best, ["series", "t"], "left"), "nearest")
        whole = F.col("_w") * scale > 2 * F.col("_m")
        done = step.filter(F.col("_b.d") <= F.col("_w") * scale).unionByName(step.filter(whole & (F.coalesce(F.col("_b.d"), F.lit(0.0)) > F.col("_w") * scale)))
        done = done.filter(F.col("_b").isNotNull()).select("series", "t", "_b.d", "_b.t2", *carry, *[F.col(f"_b.{c}2").alias(f"{c}2") for c in carry])
        found = done if found is None else found.unionByName(done)
        todo = step.filter(~whole & F.coalesce(F.col("_b.d") > F.col("_w") * scale, F.lit(True))).drop("_b")
        scale *= 4.0
    return found if found is not None else p.select("series", "t", F.lit(0.0).alias("d"), F.col("t").alias("t2"), *carry, *[F.col(c).alias(f"{c}2") for c in carry]).limit(0)


def embedding_scan(df: DataFrame, dims: Sequence[int], tau: int = 1, ratio: float = 10.0, exclude: int = 0, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, m, n, false_share, error: for each number of delays the share of nearest neighbours that one more delay moves away over `ratio` times, and the root mean square error of foretelling the next value by the neighbour's."""
    out = None
    for m in dims:
        names = [f"x{k}" for k in range(m)]
        p = delays(df, {**{f"x{k}": -k * tau for k in range(m + 1)}, "next": 1}, series, t, v)
        near = nearest(p, names, exclude, [f"x{m}", "next"])
        apart, miss = F.abs(F.col(f"x{m}") - F.col(f"x{m}2")), F.col("next") - F.col("next2")
        r = near.groupBy("series").agg(F.count("*").alias("n"), F.avg((apart > ratio * F.col("d")).cast("double")).alias("false_share"), F.sqrt(F.avg(miss * miss)).alias("error"))
        r = r.select("series", F.lit(m).alias("m"), "n", "false_share", "error")
        out = r if out is None else out.unionByName(r)
    return out


def best_embedding(scan: DataFrame, most_false: float = 0.1) -> DataFrame:
    """series, by_neighbours (the smallest m with few false ones, else the m with the fewest), by_prediction (the smallest m with the least error)."""
    few = F.min(F.when(F.col("false_share") <= most_false, F.col("m")))
    least = F.min(F.struct(F.round("false_share", 12), F.col("m"))).getField("m")
    return scan.groupBy("series").agg(F.coalesce(few, least).alias("by_neighbours"), F.min(F.struct(F.round("error", 12), F.col("m"))).getField("m").alias("by_prediction"))


def _close(points: DataFrame, radius: DataFrame, on: str) -> DataFrame:
    """Pairs of points of a series within its radius `r` on the coordinate `on`: the first's columns, r, and the second as _o."""
    p = points.join(radius, "series").filter("r > 0")
    cell = F.floor(F.col(on) / F.col("r"))
    held = p.select("series", cell.alias("_k"), F.struct(*points.columns).alias("_o"))
    asked = p.withColumn("_k", F.explode(F.array(cell - 1, cell, cell + 1)))
    return asked.join(held, ["series", "_k"]).filter(F.abs(F.col(on) - F.col(f"_o.{on}")) <= F.col("r")).drop("_k")


def serial_dependence(df: DataFrame, m: int = 2, radius: float = 0.7, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """series, n, c1, cm, statistic: whether vectors of m successive values are as often within `radius` standard deviations as single values would have it if independent.

    The statistic is near standard normal for independent draws (the test of Brock, Dechert and Scheinkman).
    """
    names = [f"x{k}" for k in range(m)]
    p = delays(df, {f"x{k}": k for k in range(m)}, series, t, v)
    r = df.groupBy(F.col(series).alias("series")).agg((F.stddev_samp(v) * radius).alias("r"))
    near = _close(p, r, "x0").filter(F.col("t") != F.col("_o.t"))
    whole = near.withColumn("_all", (_distance(names) <= F.col("r")).cast("long"))
    per = whole.groupBy("series", "t").agg(F.count("*").alias("d"), F.sum("_all").alias("a"))
    n = p.groupBy("series").agg(F.count("*").alias("n"))
    s = per.groupBy("series").agg(F.sum("d").alias("d"), F.sum(F.col("d") * (F.col("d") - 1)).alias("k"), F.sum("a").alias("a")).join(n, "series")
    s = s.filter("n > 2").select("series", "n", *[F.col(c).cast("double").alias(c) for c in ("d", "k", "a")])
    n, c = F.col("n").cast("double"), F.col("c1")
    s = s.select("series", "n", (F.col("d") / n / (n - 1)).alias("c1"), (F.col("a") / n / (n - 1)).alias("cm"), (F.col("k") / n / (n - 1) / (n - 2)).alias("k"))
    k = F.col("k")
    var = 4 * (F.pow(k, F.lit(m)) + 2 * sum((F.pow(k, F.lit(m - j)) * F.pow(c, F.lit(2 * j)) for j in range(1, m)), F.lit(0.0)) + (m - 1) ** 2 * F.pow(c, F.lit(2 * m)) - m * m * k * F.pow(c, F.lit(2 * m - 2)))
    return s.select("series", "n", "c1", "cm", F.when(var > 0, F.sqrt(n) * (F.col("cm") - F.pow(c, F.lit(m))) / F.sqrt(var)).alias("statistic"))


def correlation_transfer(df: DataFrame, radius: float = 0.5, exclude: int = 1, series: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """target, source, n, te: transfer entropy by shares of neighbours within `radius` (of standardised series), those within `exclude` steps in time left out.

    The mean over times of log(N(next, past, source) N(past) / (N(past, source) N(next, past))), over
    times that have a neighbour in all three.
    """
    s = df.groupBy(F.col(series).alias("series")).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    z = df.select(F.col(series).alias("series"), F.col(t).alias("t"), F.col(v).alias("v")).join(s, "series").filter("_s > 0").select("series", "t", ((F.col("v") - F.col("_m")) / F.col("_s")).alias("v"))
    e = delays(z, {"past": 0, "next": 1})
    own = z.select(F.col("series").alias("source"), "t", F.col("v").alias("y"))
    r = e.select("series").distinct().withColumn("r", F.lit(float(radius)))
    pairs = _close(e, r, "past").filter(F.abs(F.col("t") - F.col("_o.t")) > exclude)
    pairs = pairs.select(F.col("series").alias("target"), "t", F.col("_o.t").alias("t2"), (F.abs(F.col("next") - F.col("_o.next")) <= radius).alias("f"))
    both = pairs.join(own, "t").filter("target != source").join(own.select("source", F.col("t").alias("t2"), F.col("y").alias("y2")), ["source", "t2"])
    y = F.abs(F.col("y") - F.col("y2")) <= radius
    count = lambda c: F.sum(c.cast("long"))
    per = both.groupBy("target", "source", "t").agg(F.count("*").alias("p"), count(F.col("f")).alias("fp"), count(y).alias("py"), count(y & F.col("f")).alias("fpy")).filter("fpy > 0")
    return per.groupBy("target", "source").agg(F.count("*").alias("n"), F.avg(F.log(F.col("fpy") * F.col("p") / (F.col("py") * F.col("fp")))).alias("te"))
