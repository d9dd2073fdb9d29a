"""Reading and writing series, matrices and graphs, and seeded generators; all stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_series_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """series, t (0, 1, ... over the files by name and the lines in each), v from CSV files with a header, # comments and blank lines.

    One series a column. What isn't a number is null; the schema is read from the header, never guessed
    from the data. Rows are counted by file and split, and only those counts are summed up in order.
    """
    head = spark.read.option("comment", "#").option("header", True).csv(path)
    names = columns or head.columns
    place = F.monotonically_increasing_id()
    wide = head.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), place.alias("_place"),
        *[F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in names],
    )
    blocks = wide.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_least"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = wide.join(blocks, ["_file", "_block"])
    # Inside a split places are consecutive.
    t = (F.col("_first") + F.col("_place") - F.col("_least")).alias("t")
    return rows.select(t, *[F.col(f"`{c}`") for c in names]).unpivot(["t"], [F.col(f"`{c}`") for c in names], "series", "v").select("series", "t", "v")


def write_series_csv(long: DataFrame, path: str, most: int = 10_000) -> None:
    """One column a series; more than `most` series are an error, as a wide file can't hold them: none is left out."""
    names = [r[0] for r in long.select("series").distinct().orderBy("series").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} series: write them in parts, or in long form")
    long.groupBy("t").pivot("series", names).agg(F.first("v")).write.option("header", True).csv(path)


def read_doubles(spark: SparkSession, path: str) -> DataFrame:
    """path, i, v from raw files of little-endian 64-bit floats; each file is cut inside its own task."""
    import numpy as np
    import pandas as pd

    def run(it):
        for pdf in it:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                v = np.frombuffer(raw[: len(raw) // 8 * 8], "<f8")
                yield pd.DataFrame({"path": p, "i": np.arange(len(v)), "v": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i long, v double")


def write_doubles(df: DataFrame, path: str, group: str, order: str, v: str) -> None:
    """A row per group with its values, in order, as raw little-endian 64-bit floats; read_packed gives them back."""
    packed = df.groupBy(F.col(group).alias("group")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(v)))).alias("x"))

    @F.pandas_udf("binary")
    def raw(x):
        import numpy as np

        return x.map(lambda row: np.array([r[v] if r[v] is not None else float("nan") for r in row], "<f8").tobytes())

    packed.select("group", raw("x").alias("content")).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """group, i, v from what write_doubles wrote."""
    import numpy as np
    import pandas as pd

    df = spark.read.parquet(path)

    def run(it):
        for pdf in it:
            for g, raw in zip(pdf["group"], pdf["content"], strict=True):
                x = np.frombuffer(raw, "<f8")
                yield pd.DataFrame({"group": g, "i": np.arange(len(x)), "v": x})

    return df.mapInPandas(run, f"group {df.schema['group'].dataType.simpleString()}, i long, v double")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def edges_of_matrix(df: DataFrame, node: str, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """src, dst, weight from an adjacency matrix with a row a node and a column a target."""
    long = df.unpivot([node], columns, "dst", "weight").filter(F.col("weight") > threshold)
    return long.select(F.col(node).cast("string").alias("src"), "dst", F.col("weight").cast("double").alias("weight"))


def uniform(seed: int, *of: Column) -> Column:
    """A number in (0, 1) that a hash of the columns decides; the same on every run and partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *of: Column) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, *of)))
    return radius * F.cos(uniform(seed + 1_000_003, *of) * 6.283185307179586)


def random_graph(spark: SparkSession, nodes: int, degree: float, seed: int = 42) -> DataFrame:
    """About nodes * degree random edges without loops, drawn by edge number: no pair of nodes is visited in vain."""
    e = spark.range(int(nodes * degree)).select(
        F.floor(uniform(seed, F.col("id")) * nodes).alias("src"), F.floor(uniform(seed + 1, F.col("id")) * nodes).alias("dst")
    )
    return e.filter("src != dst").distinct()


def chain(spark: SparkSession, n: int, p: int = 3, weight: float = 0.7, seed: int = 42) -> DataFrame:
    """i, x1 .. xp: each variable is the weighted one before plus noise."""
    noise = [uniform(seed + k, F.col("id")) - 0.5 for k in range(p)]
    cols = [noise[0]]
    for k in range(1, p):
        cols.append(weight * cols[-1] + noise[k])
    return spark.range(n).select(F.col("id").alias("i"), *[c.alias(f"x{k + 1}") for k, c in enumerate(cols)])


def autoregressive(spark: SparkSession, series: int, length: int, phi: float, seed: int = 42) -> DataFrame:
    """series, t, v: independent AR(1) series; Spark deals the series out, a recurrence runs inside each."""
    import numpy as np
    import pandas as pd

    kind = T.StructType([T.StructField("series", T.LongType()), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(it):
        for pdf in it:
            for s in pdf["id"]:
                e = np.random.default_rng((seed, int(s))).normal(size=length)
                v = np.empty(length)
                last = 0.0
                for i in range(length):
                    last = v[i] = phi * last + e[i]
                yield pd.DataFrame({"series": s, "t": np.arange(length), "v": v})

    return spark.range(series).mapInPandas(run, kind)
