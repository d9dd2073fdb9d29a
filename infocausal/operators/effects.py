"""Treatment effects of a binary treatment, with bounds, sensitivity and instruments.

Frames come with columns t (0 or 1) and y (double), and z where there are strata. Everything is
conditional aggregation: rows are summed by arm or stratum first, formulas run on the few sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.scratch import materialize


def arm(stat, value: str | Column, t: int) -> Column:
    """An aggregate over one arm."""
    value = F.col(value) if isinstance(value, str) else value
    return stat(F.when(F.col("t") == t, value))


def naive(df: DataFrame) -> DataFrame:
    """n1, n0, ate, se (Welch)."""
    s = df.agg(
        arm(F.count, "y", 1).alias("n1"), arm(F.count, "y", 0).alias("n0"), (arm(F.avg, "y", 1) - arm(F.avg, "y", 0)).alias("ate"),
        arm(F.var_samp, "y", 1).alias("v1"), arm(F.var_samp, "y", 0).alias("v0"),
    )
    return s.select("n1", "n0", "ate", F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("se"))


def balance(df: DataFrame, covariates: list[str]) -> DataFrame:
    """covariate, smd: difference in means over the pooled standard deviation."""
    row = lambda c: F.struct(
        F.lit(c).alias("covariate"),
        ((arm(F.avg, c, 1) - arm(F.avg, c, 0)) / F.nullif(F.sqrt((arm(F.var_samp, c, 1) + arm(F.var_samp, c, 0)) / 2), F.lit(0.0))).alias("smd"),
    )
    return df.agg(F.array(*[row(c) for c in covariates]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def strata(df: DataFrame) -> DataFrame:
    """z, n, n1, n0, y1, y0: counts and mean outcomes by stratum."""
    return df.groupBy("z").agg(
        F.count("*").alias("n"), arm(F.count, "y", 1).alias("n1"), arm(F.count, "y", 0).alias("n0"),
        arm(F.avg, "y", 1).alias("y1"), arm(F.avg, "y", 0).alias("y0"),
    )


def stratified(df: DataFrame) -> DataFrame:
    """ate weighted by stratum size, strata with both arms only."""
    return strata(df).filter("n1 > 0 and n0 > 0").agg(
        (F.sum(F.col("n") * (F.col("y1") - F.col("y0"))) / F.sum("n")).alias("ate"), F.count("*").alias("n_strata")
    )


def g_formula(df: DataFrame) -> DataFrame:
    """Standardised means of both arms and their difference."""
    s = strata(df).filter("n1 > 0 and n0 > 0").agg(
        (F.sum(F.col("n") * F.col("y1")) / F.sum("n")).alias("y1"), (F.sum(F.col("n") * F.col("y0")) / F.sum("n")).alias("y0")
    )
    return s.select("y1", "y0", (F.col("y1") - F.col("y0")).alias("ate"))


def weighted(df: DataFrame) -> DataFrame:
    """ipw: Hajek weights with the strata's treatment shares as propensities; aipw: corrected by the strata's means."""
    s = strata(df).filter("n1 > 0 and n0 > 0").withColumn("e", F.col("n1") / F.col("n"))
    n1, n0, e = F.col("n1"), F.col("n0"), F.col("e")
    ipw = F.sum(n1 * F.col("y1") / e) / F.sum(n1 / e) - F.sum(n0 * F.col("y0") / (1 - e)) / F.sum(n0 / (1 - e))
    aipw = F.sum(F.col("n") * (F.col("y1") - F.col("y0"))) / F.sum("n")
    return s.agg(ipw.alias("ipw"), aipw.alias("aipw"))


def simpson(df: DataFrame) -> DataFrame:
    """z (null: all rows), effect, reversed: the sign differs from that of all rows. One pass by grouping sets."""
    g = df.rollup("z").agg((arm(F.avg, "y", 1) - arm(F.avg, "y", 0)).alias("effect"), F.grouping("z").alias("g"))
    whole = F.max(F.when(F.col("g") == 1, F.col("effect"))).over(Window.partitionBy())
    return g.select("z", "effect", F.coalesce((F.signum("effect") != F.signum(whole)), F.lit(False)).alias("reversed"))


def wald(df: DataFrame) -> DataFrame:
    """Complier effect with the binary instrument z: ratio of the outcome's and the treatment's differences."""
    side = lambda c, k: F.avg(F.when(F.col("z") == k, F.col(c)))
    return df.agg(((side("y", 1) - side("y", 0)) / (side("t", 1) - side("t", 0))).alias("late"))


def two_stage(df: DataFrame) -> DataFrame:
    """Slope of y on t, both through the instrument z of any kind."""
    z = F.col("z").cast("double")
    return df.agg((F.covar_pop(z, F.col("y")) / F.covar_pop(z, F.col("t").cast("double"))).alias("slope"))


def difference_in_differences(df: DataFrame) -> DataFrame:
    """t: treated group, post: later period."""
    m = lambda t, p: F.avg(F.when((F.col("t") == t) & (F.col("post") == p), F.col("y")))
    return df.agg(((m(1, 1) - m(1, 0)) - (m(0, 1) - m(0, 0))).alias("did"))


def regression_discontinuity(df: DataFrame, cutoff: float, bandwidth: float) -> DataFrame:
    """Jump of triangular-kernel means of y at the cutoff of x."""
    d = F.col("x") - cutoff
    w = 1 - F.abs(d) / bandwidth
    near = df.filter(F.abs(d) < bandwidth).select("y", w.alias("w"), (d >= 0).alias("up"))
    mean = lambda up: F.sum(F.when(F.col("up") == up, F.col("w") * F.col("y"))) / F.sum(F.when(F.col("up") == up, F.col("w")))
    return near.agg((mean(True) - mean(False)).alias("jump"), F.count("*").alias("n"))


def manski(df: DataFrame) -> DataFrame:
    """Bounds of the effect from the outcome's least and largest value, without assumptions."""
    s = df.agg(
        F.avg(F.col("t").cast("double")).alias("p"), arm(F.avg, "y", 1).alias("y1"), arm(F.avg, "y", 0).alias("y0"), F.min("y").alias("lo"), F.max("y").alias("hi")
    )
    p, q = F.col("p"), 1 - F.col("p")
    low1, high1 = F.col("y1") * p + F.col("lo") * q, F.col("y1") * p + F.col("hi") * q
    low0, high0 = F.col("y0") * q + F.col("lo") * p, F.col("y0") * q + F.col("hi") * p
    return s.select((low1 - high0).alias("lower"), (high1 - low0).alias("upper"))


def risks(df: DataFrame) -> DataFrame:
    """For y in 0 and 1: p1, p0, risk ratio, odds ratio, E-value, excess fraction, bounds of PNS, PN and PS."""
    s = df.agg(arm(F.avg, "y", 1).alias("p1"), arm(F.avg, "y", 0).alias("p0"), F.avg(F.col("t").cast("double")).alias("px"))
    p1, p0, px = F.col("p1"), F.col("p0"), F.col("px")
    rr = p1 / p0
    high = F.greatest(rr, 1 / rr)
    pns_low, pns_high = F.greatest(F.lit(0.0), p1 - p0), F.least(p1, 1 - p0)
    return s.select(
        "p1", "p0", rr.alias("rr"), (p1 * (1 - p0) / (p0 * (1 - p1))).alias("odds_ratio"), (high + F.sqrt(high * (high - 1))).alias("e_value"),
        (px * (rr - 1) / (1 + px * (rr - 1))).alias("excess_fraction"), pns_low.alias("pns_low"), pns_high.alias("pns_high"),
        (pns_low / p1).alias("pn_low"), F.least(F.lit(1.0), pns_high / p1).alias("pn_high"),
        (pns_low / (1 - p0)).alias("ps_low"), F.least(F.lit(1.0), pns_high / (1 - p0)).alias("ps_high"),
    )


def mediation(df: DataFrame) -> DataFrame:
    """a (m on t), b and direct (y on m and t), indirect, total, share and Sobel's z; columns t, m, y."""
    s = df.select(F.col("t").cast("double").alias("t"), F.col("m").cast("double").alias("m"), F.col("y").cast("double").alias("y")).agg(
        F.count("*").alias("n"), *[F.covar_pop(p, q).alias(p + q) for p, q in ("tt", "mm", "tm", "ty", "my", "yy")]
    )
    c = {k: F.col(k) for k in ("n", "tt", "mm", "tm", "ty", "my", "yy")}
    det = c["tt"] * c["mm"] - c["tm"] * c["tm"]
    a, b, d = c["tm"] / c["tt"], (c["my"] * c["tt"] - c["ty"] * c["tm"]) / det, (c["ty"] * c["mm"] - c["my"] * c["tm"]) / det
    va = (c["mm"] - a * c["tm"]) / (c["n"] - 2) / c["tt"]
    vb = (c["yy"] - b * c["my"] - d * c["ty"]) / (c["n"] - 3) * c["tt"] / det
    s = s.select(a.alias("a"), b.alias("b"), d.alias("direct"), va.alias("va"), vb.alias("vb"))
    ab = F.col("a") * F.col("b")
    se = F.sqrt(F.col("b") * F.col("b") * F.col("va") + F.col("a") * F.col("a") * F.col("vb"))
    return s.select("a", "b", "direct", ab.alias("indirect"), (ab + F.col("direct")).alias("total"), (ab / (ab + F.col("direct"))).alias("share"), (ab / se).alias("sobel_z"))


def trimmed(df: DataFrame, share: float, parts: int = 64) -> DataFrame:
    """Difference of means after `share` of each tail of each arm is cut.

    Only how often a value comes matters, so values are counted first; running counts go inside
    `parts` ranges of the values, and one range's count after another is added to them.
    """
    c = materialize(df.filter("t is not null and y is not null").groupBy("t", F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n")), "values")
    cuts = c.agg(F.percentile_approx("y", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    place = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < F.col("y")))
    c = c.crossJoin(F.broadcast(cuts)).withColumn("r", place).drop("cuts")  # one row
    ranges = c.groupBy("t", "r").agg(F.sum("n").alias("m"))
    arm_w = Window.partitionBy("t")
    first = F.coalesce(F.sum("m").over(arm_w.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    ranges = ranges.select("t", "r", first, F.sum("m").over(arm_w).alias("all"))
    upto = F.sum("n").over(Window.partitionBy("t", "r").orderBy("y")) + F.col("first")
    x = c.join(F.broadcast(ranges), ["t", "r"]).withColumn("upto", upto).withColumn("k", F.floor(F.col("all") * share))
    kept = F.greatest(F.least(F.col("upto"), F.col("all") - F.col("k")) - F.greatest(F.col("upto") - F.col("n"), F.col("k")), F.lit(0))
    x = x.select("t", "y", kept.alias("n"))
    mean = lambda t: F.sum(F.when(F.col("t") == t, F.col("y") * F.col("n"))) / F.sum(F.when(F.col("t") == t, F.col("n")))
    return x.agg((mean(1) - mean(0)).alias("ate"), F.sum("n").alias("n"))


def front_door(df: DataFrame) -> DataFrame:
    """E[y | do(t)] for both arms through the mediator m: sum over m of P(m|t) sum over t' of E[y|t',m] P(t')."""
    c = df.groupBy("t", "m").agg(F.count("*").alias("n"), F.avg("y").alias("ym"))
    nt = F.sum("n").over(Window.partitionBy("t"))
    total = F.sum("n").over(Window.partitionBy())
    c = c.select("t", "m", "ym", (F.col("n") / nt).alias("pm"), (nt / total).alias("pt"))
    inner = c.groupBy("m").agg((F.sum(F.col("ym") * F.col("pt")) / F.sum("pt")).alias("g"))
    return c.join(inner, "m").groupBy("t").agg(F.sum(F.col("pm") * F.col("g")).alias("y_do"))


def nearest_match(df: DataFrame, x: str, key: str, rows_per_cell: int = 100_000) -> DataFrame:
    """att, n1: each treated row against the control nearest in x (ties: smaller x, and of one x the largest key at or below the row, the smallest above).

    Rows with the same x are one row of counts, sums and the controls that a match takes. The nearest below
    and above are found by running windows inside ranges of x, whose edges carry the last control over.
    """
    y, k = F.col("y").cast("double"), F.struct(F.col(key).alias("k"), F.col("y").cast("double").alias("y"))
    one, two = F.col("t").cast("int") == 1, F.col("t").cast("int") == 0
    places = materialize(df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(
        F.count(F.when(one, 1)).alias("n"), F.count(F.when(one, y)).alias("ny"), F.sum(F.when(one, y)).alias("s"),
        F.min(F.when(two, k)).alias("low"), F.max(F.when(two, k)).alias("high")), "places")
    cells = places.count() // rows_per_cell + 1
    # Spark cuts the ranges by a sample; written once, so that a row's range stays.
    rows = materialize(places.repartitionByRange(cells, "x").withColumn("cell", F.spark_partition_id()), "ranges")
    high, low = (F.when(F.col(c).isNotNull(), F.struct("x", f"{c}.y")) for c in ("high", "low"))
    edge = rows.groupBy("cell").agg(F.max(high).alias("top"), F.min(low).alias("bottom"))
    by_cell = Window.orderBy("cell")  # over `cells` rows
    edge = edge.select(
        "cell", F.last("top", True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("bottom", True).over(by_cell.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # Both windows run over what came before: a frame up to the end would be read anew for every row.
    w, back = Window.partitionBy("cell").orderBy("x"), Window.partitionBy("cell").orderBy(F.desc("x"))
    r = rows.join(F.broadcast(edge), "cell").select(
        "x", "n", "ny", "s",
        F.coalesce(F.last(high, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before").alias("b"),
        F.coalesce(F.last(low, True).over(back.rowsBetween(Window.unboundedPreceding, -1)), "after").alias("a"),
    ).filter("n > 0")
    below, above = F.col("x") - F.col("b.x"), F.col("a.x") - F.col("x")
    match = F.when(F.col("a").isNull() | (below <= above), F.col("b.y")).otherwise(F.col("a.y"))
    seen = F.when(match.isNotNull(), F.col("ny"))
    att = F.sum(F.col("s") - F.col("ny") * match) / F.nullif(F.sum(seen), F.lit(0))
    return r.agg(att.alias("att"), F.coalesce(F.sum("n"), F.lit(0)).alias("n1"))


def adjusted_p(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """The rows with bonferroni, holm and bh flags; tests are ranked by p, then by all columns."""
    order = Window.orderBy(p, *[c for c in df.columns if c != p])
    whole = Window.partitionBy()
    r = df.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(whole))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    return r.select(
        *df.columns, (F.col(p) < alpha / F.col("_m")).alias("bonferroni"),
        (F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(upto) < alpha).alias("holm"),
        (F.min(F.col(p) * F.col("_m") / F.col("_i")).over(onward) < alpha).alias("bh"),
    )
