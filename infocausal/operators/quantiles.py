"""Exact percentiles of a few groups of many rows, without a group's values in one place.

Each task's sketch gives a narrow range of values that holds the wanted ranks; one more scan counts what
is below and brings the distinct values inside, by count. Where a sketch was off, the range is widened,
so the ranks are exact whatever it said.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks of a sketch are off by one in this many rows.
ACCURACY = 10_000


def percentiles(df: DataFrame, by: str, v: str, at: Sequence[float], accuracy: int = ACCURACY) -> dict:
    """by -> the interpolated percentiles `at` of v, nulls left out. For few groups, whose numbers the driver holds; df is read several times."""
    x = df.select(F.col(by).alias("g"), F.col(v).cast("double").alias("v")).filter("g is not null and v is not null")
    spark, kind = df.sparkSession, dict(x.dtypes)["g"]
    out: dict = {}
    todo, margin = None, 3 / accuracy
    while todo is None or todo:
        ends = [min(max(q + side * margin, 0.0), 1.0) for q in at for side in (-1, 1)]
        sketch = {r["g"]: r for r in x.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("e"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        if todo is None:
            out = {g: [None] * len(at) for g in sketch}
            todo = [(g, i) for g in sketch for i in range(len(at))]
            if not todo:
                break
        rank = {(g, i): (sketch[g]["n"] - 1) * at[i] for g, i in todo}
        span = lambda g, i: (sketch[g]["lo"], sketch[g]["hi"]) if margin >= 1 else tuple(sketch[g]["e"][2 * i : 2 * i + 2])  # noqa: B023, E731
        ranges = spark.createDataFrame([(g, i, math.floor(rank[g, i]), math.ceil(rank[g, i]), *span(g, i)) for g, i in todo], f"g {kind}, i int, a long, b long, lo double, hi double")
        j = x.join(F.broadcast(ranges), "g").filter("v <= hi")  # ranges: a row a group and percentile
        # What lies below the range is one row of its own, without a value.
        c = j.groupBy("g", "i", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
        c = c.withColumn("u", F.sum("n").over(Window.partitionBy("g", "i").orderBy(F.col("v").asc_nulls_first())))
        hit = lambda k: F.max(F.when((F.col(k) < F.col("u")) & (F.col(k) >= F.col("u") - F.col("n")), F.col("v"))).alias(f"v{k}")
        for r in c.groupBy("g", "i").agg(hit("a"), hit("b")).collect():
            if r["va"] is not None and r["vb"] is not None:
                part = rank[r["g"], r["i"]] % 1
                out[r["g"]][r["i"]] = (1 - part) * r["va"] + part * r["vb"] if part else r["va"]
        todo = [(g, i) for g, i in todo if out[g][i] is None]
        margin *= 16
    return out
