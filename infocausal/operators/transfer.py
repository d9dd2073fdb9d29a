"""Forms of transfer entropy and of symbolic dynamics over binned series (series, t, b), all as counts by joint state.

Pairs of series join on time once; every quantity of a pair comes from the same counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.operators import information, resampling


def _sides(e: DataFrame, t: str = "t") -> tuple[DataFrame, DataFrame]:
    x = e.select(F.col("series").alias("target"), t, F.col("past").alias("xp"), F.col("future").alias("xf"))
    return x, e.select(F.col("series").alias("source"), t, F.col("past").alias("yp"), F.col("future").alias("yf"))


def lag_scan(binned: DataFrame, lags: int) -> DataFrame:
    """target, source, lag, n_obs, te: the source's state `lag` steps before the target's next one, given the target's present."""
    e = information.embedded(binned, "series", "t", "b")
    x, y = _sides(e)
    late = binned.select(F.col("series").alias("source"), F.col("b").alias("yp"), "t").withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("t", F.col("t") + F.col("lag") - 1)
    return information.conditional_information(x.join(late, "t").filter("target != source"), "xf", "yp", ["xp"], ["target", "source", "lag"])


def best_lag(scan: DataFrame) -> DataFrame:
    """target, source, lag, te: the lag with the largest transfer, the smallest of equal ones."""
    best = F.max(F.struct(F.round("te", 12).alias("r"), (-F.col("lag")).alias("l"), "te")).alias("m")
    return scan.groupBy("target", "source").agg(best).select("target", "source", (-F.col("m.l")).alias("lag"), F.col("m.te").alias("te"))


def rates(binned: DataFrame) -> DataFrame:
    """target, source, n_obs and, in nats: h_next (of the target's next state), h_rate (given its present), te, normalized (te / h_rate),
    uncertainty (te / h_next), instant (information at the same step beyond both presents), directed (te + instant) and h_caused (what is left)."""
    x, y = _sides(information.embedded(binned, "series", "t", "b"))
    c = x.join(y, "t").filter("target != source").groupBy("target", "source", "xf", "xp", "yp", "yf").agg(F.count("*").alias("n"))
    of = lambda *k: F.sum("n").over(Window.partitionBy("target", "source", *k))
    c = c.select(
        "target", "source", "n", of().alias("t"), of("xf").alias("f"), of("xp").alias("p"), of("xf", "xp").alias("fp"), of("xp", "yp").alias("py"), of("xf", "xp", "yp").alias("fpy"),
        of("xp", "yp", "yf").alias("pyy"),
    )
    part = lambda a, b: F.sum(F.col("n") / F.col("t") * F.log(F.col(a) / F.col(b)))
    s = c.groupBy("target", "source").agg(
        F.sum("n").alias("n_obs"), part("t", "f").alias("h_next"), part("p", "fp").alias("h_rate"), part("py", "fpy").alias("h_both"), part("pyy", "n").alias("h_caused")
    )
    te, instant = F.greatest(F.col("h_rate") - F.col("h_both"), F.lit(0.0)), F.greatest(F.col("h_both") - F.col("h_caused"), F.lit(0.0))
    share = lambda c: te / F.nullif(F.col(c), F.lit(0.0))
    return s.select(
        "target", "source", "n_obs", "h_next", "h_rate", te.alias("te"), share("h_rate").alias("normalized"), share("h_next").alias("uncertainty"), instant.alias("instant"),
        (te + instant).alias("directed"), "h_caused",
    )


def long_history(binned: DataFrame, k: int, m: int) -> DataFrame:
    """target, source, n_obs, te with k steps of the target's past and m of the source's; gaps give no state."""
    w = Window.partitionBy("series").orderBy("t")
    depth = max(k, m)
    e = binned.select("series", "t", F.lead("b").over(w).alias("next"), F.lead("t").over(w).alias("t2"), F.lag("t", depth - 1).over(w).alias("t0"), *[F.lag("b", i).over(w).alias(f"b{i}") for i in range(depth)])
    e = e.filter((F.col("t2") == F.col("t") + 1) & (F.col("t0") == F.col("t") - (depth - 1)))
    x = e.select(F.col("series").alias("target"), "t", F.col("next").alias("xf"), *[F.col(f"b{i}").alias(f"x{i}") for i in range(k)])
    y = e.select(F.col("series").alias("source"), "t", F.struct(*[F.col(f"b{i}") for i in range(m)]).alias("ys"))
    return information.conditional_information(x.join(y, "t").filter("target != source"), "xf", "ys", [f"x{i}" for i in range(k)], ["target", "source"])


def effective(binned: DataFrame, replicates: int) -> DataFrame:
    """target, source, te, bias (mean over shuffled sources), effective (te - bias), z."""
    e = information.embedded(binned, "series", "t", "b")
    x, y = _sides(e)
    te = information.conditional_information(x.join(y, "t").filter("target != source"), "xf", "yp", ["xp"], ["target", "source"])
    place = e.select("series", "t", (F.row_number().over(Window.partitionBy("series").orderBy("t")) - 1).cast("long").alias("i"))
    mixed = resampling.shuffled(e.select("series", "t", F.col("past").alias("v")), replicates).join(place, ["series", "i"])
    y = mixed.select(F.col("series").alias("source"), "rep", "t", F.col("v").alias("yp"))
    other = information.conditional_information(x.join(y, "t").filter("target != source"), "xf", "yp", ["xp"], ["target", "source", "rep"])
    b = other.groupBy("target", "source").agg(F.avg("te").alias("bias"), F.stddev_samp("te").alias("sd"))
    gap = F.col("te") - F.col("bias")
    return te.join(b, ["target", "source"]).select("target", "source", "te", "bias", gap.alias("effective"), (gap / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"))


def network(te: DataFrame, deviations: float = 0.5) -> DataFrame:
    """source, target, te, density: pairs over the mean by so many standard deviations, and their share of all pairs."""
    whole = te.agg((F.avg("te") + deviations * F.stddev_samp("te")).alias("cut"), F.count("*").alias("pairs"))
    kept = te.crossJoin(F.broadcast(whole)).filter("te > cut")  # one row
    n = kept.agg(F.count("*").alias("k"))
    return kept.crossJoin(F.broadcast(n)).select("source", "target", "te", (F.col("k") / F.col("pairs")).alias("density"))


def self_information(binned: DataFrame, lags: int) -> DataFrame:
    """series, lag, mi, first_minimum: information between a state and that `lag` steps later; the first lag whose neighbours have no less is a usual delay for embedding."""
    late = binned.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select("series", "lag", (F.col("t") - F.col("lag")).alias("t"), F.col("b").alias("later"))
    mi = information.mutual_information(binned.join(late, ["series", "t"]), "b", "later", ["series", "lag"])
    w = Window.partitionBy("series")
    by = w.orderBy("lag")
    r = F.round("mi", 12)
    dip = (r <= F.lag(r).over(by)) & (r <= F.lead(r).over(by))
    m = mi.withColumn("dip", dip)
    return m.select("series", "lag", "mi", F.min(F.when(F.col("dip"), F.col("lag"))).over(w).alias("first_minimum"))


def multiscale_permutation_entropy(df: DataFrame, scales: int, order: int = 3) -> DataFrame:
    """series, scale, h, normalized: of the ordinal patterns of means over `scale` steps."""
    import math

    s = df.withColumn("scale", F.explode(F.sequence(F.lit(1), F.lit(scales))))
    g = s.groupBy("scale", "series", F.floor(F.col("t") / F.col("scale")).alias("t")).agg(F.avg("v").alias("v"))
    w = Window.partitionBy("scale", "series").orderBy("t")
    p = g.select("scale", "series", information.ordinal_pattern("v", order, w).alias("b")).filter("b is not null")
    return information.state_entropy(p, ["b"], ["scale", "series"]).withColumn("normalized", F.col("h") / math.log(math.factorial(order)))


def pattern_transitions(patterns: DataFrame) -> DataFrame:
    """series, b, next, n, p, h: how often a pattern follows another (neighbours in time), and the mean entropy of the next one given the present."""
    e = information.embedded(patterns, "series", "t", "b")
    c = e.groupBy("series", F.col("past").alias("b"), F.col("future").alias("next")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("series")
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("series", "b")))
    return c.withColumn("h", -F.sum(F.col("n") * F.log("p")).over(w) / F.sum("n").over(w))
