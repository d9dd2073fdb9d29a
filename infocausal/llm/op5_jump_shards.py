"""Sharding by jump consistent hashing.

The key's mixed 64-bit value walks the jumps of the published algorithm; with one more shard a
key either stays or moves to the new shard. There is no ring table.

Defined cases: a null key has the value 0; null text has no bytes; repeated rows are kept and get
slots of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from infocausal.llm.common import materialize, n_tasks

SHARDS = 24
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to shards - 1) of each unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    active, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(active):
        key = key * _STEP + np.uint64(1)
        at_next = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        out[active] = at
        go = at_next < shards
        active, key, at = active[go], key[go], at_next[go]
    return out


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy().view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(F.coalesce(key, F.lit(0))))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A slot is the row's place in its shard: rows are numbered inside hashed pieces of the shard,
    and pieces are laid one after another by a running sum of their counts, so no task sorts a shard.
    """
    pieces = n_tasks(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
    ).withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(5)), F.lit(pieces)).cast("int"))
    rows = materialize(rows, "sharded")
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("i", F.row_number().over(inside))
        .join(starts, ["shard", "piece"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("i") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
