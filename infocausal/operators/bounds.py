"""Bounds of effects and their sensitivity: every estimator is one aggregation over (t, y) and perhaps z or m."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.operators.effects import arm
from infocausal.operators.quantiles import percentiles
from infocausal.scratch import materialize


def monotone(df: DataFrame) -> DataFrame:
    """Bounds of the effect where treatment never lowers the outcome (mtr), where the treated have no worse outcomes (mts), and both."""
    s = df.agg(F.avg(F.col("t").cast("double")).alias("p"), arm(F.avg, "y", 1).alias("y1"), arm(F.avg, "y", 0).alias("y0"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    p, q, y1, y0, lo, hi = F.col("p"), 1 - F.col("p"), F.col("y1"), F.col("y0"), F.col("lo"), F.col("hi")
    wide_low, wide_high = y1 * p + lo * q - (y0 * q + hi * p), y1 * p + hi * q - (y0 * q + lo * p)
    return s.select(
        F.greatest(wide_low, F.lit(0.0)).alias("mtr_low"), wide_high.alias("mtr_high"), wide_low.alias("mts_low"), (y1 - y0).alias("mts_high"),
        F.lit(0.0).alias("both_low"), (y1 - y0).alias("both_high"),
    )


def instrument_bounds(df: DataFrame) -> DataFrame:
    """Sharp bounds of the effect of a binary t on a binary y with a binary instrument z; consistent: whether an instrument can give these data."""
    joint = {f"p{y}{t}{z}": F.avg(F.when(F.col("z") == z, ((F.col("y") == y) & (F.col("t") == t)).cast("double"))).alias(f"p{y}{t}{z}") for y in (0, 1) for t in (0, 1) for z in (0, 1)}
    s = df.agg(*joint.values())
    p = lambda k: F.col(f"p{k}")  # noqa: E731  y, t, z
    low = F.greatest(
        p("110") + p("001") - 1, p("111") + p("000") - 1, p("110") - p("111") - p("101") - p("010") - p("100"), p("111") - p("110") - p("100") - p("011") - p("101"),
        -p("011") - p("101"), -p("010") - p("100"), p("001") - p("011") - p("101") - p("010") - p("000"), p("000") - p("010") - p("100") - p("011") - p("001"),
    )
    high = F.least(
        1 - p("010") - p("101"), 1 - p("011") - p("100"), -p("010") + p("011") + p("001") + p("110") + p("000"), -p("011") + p("111") + p("001") + p("010") + p("000"),
        p("111") + p("001"), p("110") + p("000"), -p("101") + p("111") + p("001") + p("110") + p("100"), -p("100") + p("110") + p("000") + p("111") + p("101"),
    )
    fits = F.greatest(*[F.greatest(p(f"0{t}0"), p(f"0{t}1")) + F.greatest(p(f"1{t}0"), p(f"1{t}1")) for t in (0, 1)]) <= 1
    return s.select(low.alias("lower"), high.alias("upper"), fits.alias("consistent"))


def missing_outcomes(df: DataFrame) -> DataFrame:
    """seen, lower, upper: bounds of the mean where y is null, from the least and largest value that is seen."""
    s = df.agg(F.count("y").alias("k"), F.count("*").alias("n"), F.avg("y").alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    p = F.col("k") / F.col("n")
    return s.select(p.alias("seen"), (F.col("m") * p + F.col("lo") * (1 - p)).alias("lower"), (F.col("m") * p + F.col("hi") * (1 - p)).alias("upper"))


def quantile_effects(df: DataFrame, at: list[float]) -> DataFrame:
    """q, y1, y0, effect: differences of the arms' quantiles."""
    rows = materialize(df.select(F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y")), "arms")
    found = percentiles(rows, "t", "y", at)
    none = [None] * len(at)
    s = df.sparkSession.createDataFrame(list(zip(map(float, at), found.get(1, none), found.get(0, none), strict=True)), "q double, y1 double, y0 double")
    return s.withColumn("effect", F.col("y1") - F.col("y0"))


def dominance(df: DataFrame, cells: int = 200) -> DataFrame:
    """first_order, second_order: largest excess of the treated arm's distribution (and of its integral) over the other's on a grid of y; not over 0: it dominates."""
    ends = df.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    step = F.nullif((F.col("hi") - F.col("lo")) / cells, F.lit(0.0))
    cell = F.coalesce(F.least(F.floor((F.col("y") - F.col("lo")) / step), F.lit(cells - 1)), F.lit(0)).cast("int")
    c = df.crossJoin(F.broadcast(ends)).groupBy(cell.alias("b")).agg(F.sum(F.col("t").cast("int")).alias("k1"), F.sum(1 - F.col("t").cast("int")).alias("k0"))
    w, whole = Window.orderBy("b"), Window.partitionBy()  # over `cells` rows at most
    d = c.select("b", (F.sum("k1").over(w) / F.sum("k1").over(whole) - F.sum("k0").over(w) / F.sum("k0").over(whole)).alias("d"))
    d = d.withColumn("next", F.coalesce(F.lead("b").over(w), F.col("b") + 1)).withColumn("s", F.sum(F.col("d") * (F.col("next") - F.col("b"))).over(w))
    return d.agg(F.max("d").alias("first_order"), (F.max("s") / cells).alias("second_order"))


def attributable(df: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """For y in 0 and 1: rr and attributable fraction of the treated with their intervals (delta method), that of all, risk difference, number needed."""
    y = F.col("y").cast("double")
    s = df.select("t", y.alias("y")).agg(arm(F.avg, "y", 1).alias("p1"), arm(F.avg, "y", 0).alias("p0"), arm(F.sum, "y", 1).alias("a"), arm(F.sum, "y", 0).alias("c"),
                                         F.sum(F.col("t").cast("int")).alias("n1"), F.sum(1 - F.col("t").cast("int")).alias("n0"), F.avg("y").alias("p"))
    rr = F.col("p1") / F.col("p0")
    se = F.sqrt(1 / F.col("a") - 1 / F.col("n1") + 1 / F.col("c") - 1 / F.col("n0"))
    low, high = rr * F.exp(-z * se), rr * F.exp(z * se)
    rd = F.col("p1") - F.col("p0")
    return s.select(
        rr.alias("rr"), low.alias("rr_low"), high.alias("rr_high"), (1 - 1 / rr).alias("fraction"), (1 - 1 / low).alias("fraction_low"), (1 - 1 / high).alias("fraction_high"),
        (1 - F.col("p0") / F.col("p")).alias("population_fraction"), rd.alias("risk_difference"), (1 / F.nullif(F.abs(rd), F.lit(0.0))).alias("number_needed"),
    )


def subgroup_effects(df: DataFrame) -> DataFrame:
    """z, n, cate and the three averages of it over all rows (ate), the treated (att) and the others (atu)."""
    s = df.groupBy("z").agg(F.count("*").alias("n"), F.sum(F.col("t").cast("int")).alias("n1"), arm(F.avg, "y", 1).alias("y1"), arm(F.avg, "y", 0).alias("y0"))
    s = s.filter("y1 is not null and y0 is not null").withColumn("cate", F.col("y1") - F.col("y0"))
    whole = Window.partitionBy()  # over strata
    mean = lambda w: F.sum(F.col("cate") * w).over(whole) / F.sum(w).over(whole)
    return s.select("z", "n", "cate", mean(F.col("n")).alias("ate"), mean(F.col("n1")).alias("att"), mean(F.col("n") - F.col("n1")).alias("atu"))


def effect_size(df: DataFrame) -> DataFrame:
    """cohens_d (pooled), hedges_g, glass_delta, overlap statistic t, n."""
    s = df.agg(arm(F.avg, "y", 1).alias("a"), arm(F.avg, "y", 0).alias("b"), arm(F.var_samp, "y", 1).alias("va"), arm(F.var_samp, "y", 0).alias("vb"),
               F.sum(F.col("t").cast("int")).alias("n1"), F.sum(1 - F.col("t").cast("int")).alias("n0"))
    n1, n0, d = F.col("n1"), F.col("n0"), F.col("a") - F.col("b")
    pooled = F.sqrt(((n1 - 1) * F.col("va") + (n0 - 1) * F.col("vb")) / (n1 + n0 - 2))
    return s.select(
        (d / pooled).alias("cohens_d"), (d / pooled * (1 - 3 / (4 * (n1 + n0) - 9.0))).alias("hedges_g"), (d / F.sqrt("vb")).alias("glass_delta"),
        (d / F.sqrt(F.col("va") / n1 + F.col("vb") / n0)).alias("welch_t"), (n1 + n0).alias("n"),
    )


def marginal_structural(df: DataFrame) -> DataFrame:
    """intercept, slope, effective_n: y on t with the stabilised weights P(t) / P(t | z); the weights come from counts by stratum."""
    c = df.groupBy("z", "t").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    nz, nt, total = (F.sum("n").over(Window.partitionBy(*k)) for k in (["z"], ["t"], []))
    c = c.select("t", "n", "s", ((nt / total) / (F.col("n") / nz)).alias("w"))
    m = c.groupBy("t").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"), F.sum(F.col("w") * F.col("n")).alias("w1"), F.sum(F.col("w") * F.col("w") * F.col("n")).alias("w2"))
    of = lambda k: F.max(F.when(F.col("t") == k, F.col("m")))
    return m.agg(of(0).alias("intercept"), (of(1) - of(0)).alias("slope"), (F.sum("w1") * F.sum("w1") / F.sum("w2")).alias("effective_n"))


def interacting_mediation(df: DataFrame) -> DataFrame:
    """Mediation with y on t, m and t * m for a binary t, from the arms' regressions of y on m.

    cde: controlled direct effect with m at its mean; nde, nie: natural direct and indirect effect; total;
    mediated, eliminated: shares of the total; interaction: the product's coefficient.
    """
    y, m = F.col("y").cast("double"), F.col("m").cast("double")
    side = lambda f, k, *c: f(*[F.when(F.col("t") == k, x) for x in c])
    s = df.agg(F.avg(m).alias("mm"), *[
        x for k in (0, 1) for x in (side(F.avg, k, m).alias(f"m{k}"), side(F.avg, k, y).alias(f"y{k}"), side(F.covar_pop, k, m, y).alias(f"my{k}"), side(F.var_pop, k, m).alias(f"v{k}"))
    ])
    slope = lambda k: F.col(f"my{k}") / F.nullif(F.col(f"v{k}"), F.lit(0.0))
    at = lambda k, x: F.col(f"y{k}") + slope(k) * (x - F.col(f"m{k}"))
    nde, nie = at(1, F.col("m0")) - at(0, F.col("m0")), slope(1) * (F.col("m1") - F.col("m0"))
    cde, total = at(1, F.col("mm")) - at(0, F.col("mm")), F.col("y1") - F.col("y0")
    return s.select(
        cde.alias("cde"), nde.alias("nde"), nie.alias("nie"), total.alias("total"), (nie / total).alias("mediated"), ((total - cde) / total).alias("eliminated"),
        (slope(1) - slope(0)).alias("interaction"),
    )


def mediator_sensitivity(df: DataFrame, rhos: list[float]) -> DataFrame:
    """rho, nie: the indirect effect t -> m -> y if the errors of m and y correlate by rho; and at which rho it is gone."""
    t, m, y = (F.col(c).cast("double") for c in "tmy")
    s = df.agg(*[F.covar_pop(a, b).alias(n) for n, (a, b) in {"tt": (t, t), "tm": (t, m), "ty": (t, y), "mm": (m, m), "yy": (y, y), "my": (m, y)}.items()])
    a = F.col("tm") / F.col("tt")
    s1, s2 = F.sqrt(F.col("yy") - F.col("ty") * F.col("ty") / F.col("tt")), F.sqrt(F.col("mm") - a * F.col("tm"))
    r = (F.col("my") - F.col("ty") * F.col("tm") / F.col("tt")) / (s1 * s2)
    s = s.select(a.alias("a"), s1.alias("s1"), s2.alias("s2"), r.alias("r")).withColumn("rho", F.explode(F.array(*map(F.lit, rhos))))
    nie = F.col("a") * F.col("s1") / F.col("s2") * (F.col("r") - F.col("rho") * F.sqrt((1 - F.col("r") * F.col("r")) / (1 - F.col("rho") * F.col("rho"))))
    return s.select("rho", nie.alias("nie"), F.col("r").alias("zero_at"))


def confounding(df: DataFrame, u: str) -> DataFrame:
    """crude, adjusted, bias of the effect on y in 0 and 1 when a binary u is left out: risk differences, and the risk ratio that u would need (Cornfield)."""
    s = df.groupBy(F.col(u).alias("u")).agg(F.count("*").alias("n"), arm(F.avg, "y", 1).alias("p1"), arm(F.avg, "y", 0).alias("p0"))
    adjusted = s.agg((F.sum(F.col("n") * (F.col("p1") - F.col("p0"))) / F.sum("n")).alias("adjusted"))
    c = df.agg(arm(F.avg, "y", 1).alias("q1"), arm(F.avg, "y", 0).alias("q0"), arm(F.avg, F.col(u).cast("double"), 1).alias("u1"), arm(F.avg, F.col(u).cast("double"), 0).alias("u0"))
    c = c.crossJoin(adjusted)  # one row each
    need = F.greatest(F.col("q1") / F.col("q0"), F.col("q0") / F.col("q1"))
    have = F.greatest(F.col("u1") / F.col("u0"), F.col("u0") / F.col("u1"))
    crude = F.col("q1") - F.col("q0")
    return c.select(crude.alias("crude"), "adjusted", (crude - F.col("adjusted")).alias("bias"), need.alias("needed"), have.alias("imbalance"), (have >= need).alias("could_explain"))


def sample_size(effect: float, sd: float, alpha_z: float = 1.959963984540054, power_z: float = 0.8416212335729143) -> int:
    """Rows an arm that show `effect` with the power and level whose normal quantiles are given."""
    return math.ceil(2 * ((alpha_z + power_z) * sd / effect) ** 2)


def detectable_effect(n: int, sd: float, alpha_z: float = 1.959963984540054, power_z: float = 0.8416212335729143) -> float:
    """The smallest effect that n rows an arm show."""
    return (alpha_z + power_z) * sd * math.sqrt(2 / n)


def critical_gamma(bounds: DataFrame, z: float = 1.6448536269514722) -> DataFrame:
    """gamma: the largest of signed_rank_bounds' odds at which the effect is still significant; null if at none."""
    return bounds.agg(F.max(F.when(F.col("z") > z, F.col("gamma"))).alias("gamma"))
