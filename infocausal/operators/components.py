"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.scratch import materialize, n_tasks

EDGES_PER_TASK = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them. Repeated edges do no harm until the end."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    links = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node of the component) for every node that has an edge.

    Large-star and small-star steps by turns, each a shuffle of at most the edges; every round
    is written to the shared folder. The driver sees a count and a checksum a round. Null ends
    and loops are dropped; a node that has only those does not show. A hub's rows pass through
    a partial minimum and a join that adaptive execution can split.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u != v")
    e = materialize(e.distinct(), "edges")
    before = _state(e)
    # Few edges make few tasks; from EDGES_PER_TASK times the shuffle partitions on this changes nothing.
    tasks = min(n_tasks(edges.sparkSession), max(8, before[0] // EDGES_PER_TASK))
    for _ in range(max_rounds if before[0] else 0):
        e = materialize(_small_star(_large_star(e, tasks), tasks), "stars")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    child = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return child.unionByName(roots)
