"""Structured Streaming forms: windowed sums with a watermark, smoothing with state, and statistics by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from infocausal.operators import information


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours", ts: str = "ts", series: str = "event_type", value: str = "value") -> DataFrame:
    """series, start, n, v: sums by tumbling window; rows later than `late` are dropped as the watermark says."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, length), F.col(series).alias("series"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("v")).select("series", F.col("window.start").alias("start"), "n", "v")


def smoothed(events: DataFrame, alpha: float, ts: str = "ts", series: str = "event_type", value: str = "value") -> DataFrame:
    """series, n, s: the running exponential mean by series, one row a series and micro-batch; the state is two numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(ts)
        for v in rows[value]:
            s = v if n == 0 else alpha * v + (1 - alpha) * s
            n += 1
        state.update((n, float(s)))
        yield pd.DataFrame({"series": [key[0]], "n": [n], "s": [s]})

    return events.select(series, ts, value).groupBy(series).applyInPandasWithState(
        step, "series string, n long, s double", "n long, s double", "update", GroupStateTimeout.NoTimeout
    )


def transfer_entropy_sink(bins: int, write: Callable[[DataFrame, int], None], history: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on windowed sums: after each batch the pairs' transfer entropy over `history` plus the batch goes to `write`.

    `history` reads the sums that are stored so far (series, start, v); a batch is taken once by its keys, so a replay changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = history().select("series", "start", "v").unionByName(df.select("series", "start", "v")).dropDuplicates(["series", "start"])
        t = rows.select("series", F.floor(F.unix_micros("start") / 3_600_000_000).alias("t"), "v")
        binned = information.equal_width_bins(t, "v", bins, ["series"])
        write(information.transfer_entropy_pairs(information.embedded(binned, "series", "t", "b"), "series", "t"), number)

    return batch
