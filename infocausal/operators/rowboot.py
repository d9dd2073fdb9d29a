"""Standard errors of effects by row bootstrap: every replicate weighs each row by a Poisson draw.

The draw follows from a hash of the row's key, so it is the same on every run and partitioning, and
no row is moved or counted. A row meets all replicates in its own task and is summed there by
replicate, stratum and arm, as products of a batch's draws and values; what is shuffled follows
replicates times strata, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Distribution of a Poisson draw of mean 1 at 0 to 5; larger draws (6 rows in 10,000) count as 6.
CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
#: Replicates that one hash serves, with 32 bits each.
PER_HASH = 4


def weighted_rows(df: DataFrame, key: Sequence[str], replicates: int) -> DataFrame:
    """The rows with rep (0 to replicates - 1) and w (how often the replicate takes the row), those with w over 0. Rows with one key draw alike."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    h = df.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // PER_HASH))))
    h = h.withColumn("_m", F.md5(F.concat(name, F.lit("|"), F.col("_h").cast("string"))))
    x = h.withColumn("_s", F.explode(F.array(*map(F.lit, range(PER_HASH))))).withColumn("rep", F.col("_h") * PER_HASH + F.col("_s")).filter(F.col("rep") < replicates)
    # Hex digits of one length and case compare like their numbers, so no draw is turned into one.
    u, cuts = F.substr(F.col("_m"), F.col("_s") * 8 + 1, F.lit(8)), [f"{int(c * 2**32):08x}" for c in CUTS]
    kept = x.withColumn("_u", u).filter(F.col("_u") > cuts[0])
    return kept.withColumn("w", sum(((F.col("_u") > c).cast("int") for c in cuts[1:]), F.lit(1))).drop("_h", "_m", "_s", "_u")


#: Groups whose sums a task holds before it sends them.
HELD = 4096


def weighted_sums(df: DataFrame, key: Sequence[str], replicates: int, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """by, rep, n (the sum of w over the rows that weighted_rows would give) and for each value the sum of w times it; groups without such a row have none."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    hashes = -(-replicates // PER_HASH)
    draws = F.unhex(F.concat(*[F.md5(F.concat(name, F.lit(f"|{h}"))) for h in range(hashes)]))
    rows = df.select(draws.alias("_m"), *by, *[v.cast("double").alias(k) for k, v in values.items()])
    cuts = [np.uint32(int(c * 2**32)) for c in CUTS]
    schema = StructType([*[rows.schema[c] for c in by], *[StructField(c, DoubleType() if c != "rep" else IntegerType()) for c in ("rep", "n", *values)]])
    names, groups, summed = schema.names, list(by), list(values)  # a task gets no Column

    def sent(sums: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        of = [pa.array([g[i] for g in sums for _ in range(replicates)], k) for i, k in enumerate(types)]
        total = np.concatenate(list(sums.values()))
        rep = pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(sums)))
        return pa.RecordBatch.from_arrays([*of, rep, *[pa.array(total[:, i]) for i in range(total.shape[1])]], names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in it:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in groups]
            u = np.frombuffer(b"".join(batch.column("_m").to_pylist()), ">u4").astype(np.uint32).reshape(batch.num_rows, -1)[:, :replicates]
            w = np.zeros(u.shape, np.uint8)
            for c in cuts:
                w += u > c
            v = np.column_stack([np.ones(batch.num_rows), *[batch.column(c).to_numpy(zero_copy_only=False) for c in summed]])
            code = np.zeros(batch.num_rows, np.int64)
            for c in groups:
                own = batch.column(c).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            first = [batch.column(c).take(pa.array(order[starts])).to_pylist() for c in groups]
            for g, part in enumerate(np.split(order, starts[1:])):
                at = tuple(f[g] for f in first)
                s = w[part].astype(float).T @ v[part]
                sums[at] = sums[at] + s if at in sums else s
            if len(sums) > HELD:
                yield sent(sums, types)
                sums = {}
        if sums:
            yield sent(sums, types)

    total = rows.mapInArrow(run, schema).groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in ("n", *values)])
    return total.filter("n > 0")


def weight_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} > {c})::INT" for c in CUTS) + ")"


def intervals(replicated: DataFrame, own: DataFrame, names: Sequence[str], level: float = 0.95) -> DataFrame:
    """estimator, estimate (of the rows as they are), se, low, high (percentiles), replicates; own: one row with the estimates."""
    tail = (1 - level) / 2
    long = lambda d, v, *more: d.select(*more, F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), F.col(n).alias(v)) for n in names])).alias("x")).select(*more, "x.*")
    s = long(replicated, "e").groupBy("estimator").agg(
        F.stddev_samp("e").alias("se"), F.percentile("e", F.lit(tail)).alias("low"), F.percentile("e", F.lit(1 - tail)).alias("high"), F.count("e").alias("replicates")
    )
    return long(own, "estimate").join(s, "estimator").select("estimator", "estimate", "se", "low", "high", "replicates")


def strata_estimates(c: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, naive, stratified, weighted, doubly_robust from counts n and sums s of y by z and t. Strata without an arm are left out of all but the naive.

    With chances and outcomes by stratum the last three agree; with fewer weights than strata they would not.
    """
    at = lambda v, t: F.sum(F.when(F.col("t") == t, F.col(v)))
    z = c.groupBy(*by, "z").agg(*[at(v, t).alias(f"{v}{t}") for v in "ns" for t in (0, 1)])
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    n = F.when(both, F.col("n0") + F.col("n1"))
    m1, m0 = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    e = F.col("n1") / (F.col("n0") + F.col("n1"))
    return z.groupBy(*by).agg(
        (F.sum("s1") / F.sum("n1") - F.sum("s0") / F.sum("n0")).alias("naive"), (F.sum(n * (m1 - m0)) / F.sum(n)).alias("stratified"),
        (F.sum(F.when(both, F.col("s1") / e)) / F.sum(F.when(both, F.col("n1") / e)) - F.sum(F.when(both, F.col("s0") / (1 - e))) / F.sum(F.when(both, F.col("n0") / (1 - e)))).alias("weighted"),
        (F.sum(F.when(both, F.col("s1") - F.col("n1") * m0)) / F.sum(F.when(both, F.col("n1")))).alias("treated"),
    )


ESTIMATORS = ("naive", "stratified", "weighted", "treated")


def effect_errors(df: DataFrame, key: Sequence[str], replicates: int = 200, level: float = 0.95) -> DataFrame:
    """estimator, estimate, se, low, high, replicates of the effect of t on y: naive, by strata z, by weights, and among the treated."""
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "z", F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y")).na.drop(subset=["t", "y"])
    counted = lambda d, w, *by: d.groupBy(*by, "z", "t").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("s"))
    reps = strata_estimates(weighted_sums(rows, [f"_k{i}" for i in range(len(key))], replicates, ["z", "t"], {"s": F.col("y")}), ["rep"])
    own = strata_estimates(counted(rows, F.lit(1)), [])
    return intervals(reps, own, ESTIMATORS, level)


def moment_errors(df: DataFrame, columns: Sequence[str], key: Sequence[str], estimates: Callable[[Callable[[str, str], Column]], dict[str, Column]], replicates: int = 200, level: float = 0.95) -> DataFrame:
    """As effect_errors, for anything that follows from covariances: estimates(cov) gives named columns from cov(a, b)."""
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    sums = {**{f"s_{a}": F.col(a) for a in columns}, **{f"s_{a}_{b}": F.col(a) * F.col(b) for a, b in pairs}}

    def moments(d: DataFrame, *by: str) -> DataFrame:
        mean = lambda *x: F.col("_".join(["s", *x])) / F.col("n")
        out = d.select(*by, *[(mean(a, b) - mean(a) * mean(b)).alias(f"c_{a}_{b}") for a, b in pairs])
        made = estimates(lambda a, b: F.col(f"c_{a}_{b}" if (a, b) in pairs else f"c_{b}_{a}"))
        return out.select(*by, *[c.alias(n) for n, c in made.items()])

    own = moments(rows.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()]))
    reps = moments(weighted_sums(rows, [f"_k{i}" for i in range(len(key))], replicates, [], sums), "rep")
    return intervals(reps, own, [c for c in own.columns], level)


def mediated(cov: Callable[[str, str], Column]) -> dict[str, Column]:
    """direct, indirect and total effect of t on y through m in linear models."""
    tt, mm, tm, ty, my = (cov(*x) for x in (("t", "t"), ("m", "m"), ("t", "m"), ("t", "y"), ("m", "y")))
    det = tt * mm - tm * tm
    b, direct = (tt * my - tm * ty) / det, (mm * ty - tm * my) / det
    return {"direct": direct, "indirect": tm / tt * b, "total": ty / tt}
