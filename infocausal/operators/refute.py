"""Checks that an effect's estimate should survive, and trials in which units don't take what they were assigned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infocausal.operators.rowboot import strata_estimates


def coin(key: Sequence[str], salt: str) -> Column:
    """A number from 0 to 1 that a hash of the row's key decides."""
    return F.conv(F.substring(F.md5(F.concat(F.concat_ws("|", *[F.col(c).cast("string") for c in key]), F.lit(f"|{salt}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def refutations(df: DataFrame, key: Sequence[str], share: float = 0.8) -> DataFrame:
    """test, naive, stratified of the effect of t on y by strata z: as it is; with a treatment that a coin of the same share gives (should vanish);
    with strata split by a coin (should stay); and in a random part of the rows (should stay).

    All four come from one table of counts by stratum, arm and coins.
    """
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "z", F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y")).na.drop(subset=["t", "y"])
    k = [f"_k{i}" for i in range(len(key))]
    treated = rows.agg(F.avg("t").alias("p")).first()["p"] or 0.0
    c = rows.groupBy("z", "t", (coin(k, "placebo") < treated).cast("int").alias("pt"), (coin(k, "cause") < 0.5).cast("int").alias("pz"), (coin(k, "part") < share).alias("part")).agg(
        F.count("*").alias("n"), F.sum("y").alias("s"))
    zed = F.col("z").cast("string")
    kinds = {
        "none": (zed, F.col("t"), F.lit(True)), "placebo": (zed, F.col("pt"), F.lit(True)), "random cause": (F.concat_ws("|", zed, F.col("pz").cast("string")), F.col("t"), F.lit(True)),
        "part": (zed, F.col("t"), F.col("part")),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("test"), z.alias("z"), t.alias("t"), keep.alias("keep")) for n, (z, t, keep) in kinds.items()])
    x = c.select("n", "s", F.explode(rows).alias("x")).select("n", "s", "x.*").filter("keep").groupBy("test", "z", "t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return strata_estimates(x, ["test"]).select("test", "naive", "stratified")


def compliance(df: DataFrame, assigned: str, taken: str, y: str) -> DataFrame:
    """n, intention (assigned against not), per_protocol (those who kept to it), as_treated (by what was taken), uptake (difference in taking), compliers (the effect among those who do as assigned), one_sided (whether nobody took it unassigned)."""
    z, t = F.col(assigned).cast("int"), F.col(taken).cast("int")
    mean = lambda c, v=y: F.avg(F.when(c, F.col(v).cast("double")))
    s = df.na.drop(subset=[assigned, taken, y]).agg(
        F.count("*").alias("n"), (mean(z == 1) - mean(z == 0)).alias("intention"), (mean((z == 1) & (t == 1)) - mean((z == 0) & (t == 0))).alias("per_protocol"),
        (mean(t == 1) - mean(t == 0)).alias("as_treated"), (mean(z == 1, taken) - mean(z == 0, taken)).alias("uptake"), (F.sum(F.when((z == 0) & (t == 1), 1).otherwise(0)) == 0).alias("one_sided"),
    )
    return s.select("n", "intention", "per_protocol", "as_treated", "uptake", (F.col("intention") / F.nullif(F.col("uptake"), F.lit(0.0))).alias("compliers"), "one_sided")
