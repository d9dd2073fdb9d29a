"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infocausal.scratch import free_shuffles, materialize, n_tasks, scratch_dir

__all__ = ["free_shuffles", "let", "materialize", "n_tasks", "release", "scratch_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`.

    Inside higher-order functions the optimizer would otherwise inline the expression
    into a lambda and evaluate it per element.
    """
    return F.transform(F.array(value), body).getItem(0)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers outlive tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
