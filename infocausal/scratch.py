"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where nothing is set on one machine (tests), a folder of this process is made once; a cluster needs the setting.
    """
    shared = spark.conf.get(SCRATCH, None) or spark.sparkContext.getConf().get(SCRATCH)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {SCRATCH} to a folder that the driver and all executors share")
    own = getattr(scratch_dir, "_own", None)
    if own is None:
        own = scratch_dir._own = tempfile.mkdtemp(prefix="infocausal-")
    return f"file://{own}"


#: Paths of the tables written by this process.
tables: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back.

    The files outlive lost executors, carry statistics for the planner and allow column pruning.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_unread(spark: SparkSession, paths: list[str], frames: list[DataFrame]) -> None:
    """Remove those of the paths that none of the frames reads, and take them off the list.

    For a caller that made these tables and whose results have been written elsewhere by now.
    """
    read = [f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()] if paths else []
    for path in [t for t in paths if not any(r.endswith(t.split("//", 1)[-1].lstrip("/")) for r in read)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)


def n_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Rows that one task sorts or counts, where a step sets its own number of tasks.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that keep each at some TASK_ROWS, whatever the number of shuffle partitions is set to."""
    return max(n_tasks(spark), -(-rows // TASK_ROWS))


def bucketed(df: DataFrame, label: str, n: int, key: str) -> DataFrame:
    """As materialize, for a table that is joined by `key` again and again: it is dealt to n buckets once, and joins don't shuffle it.

    The rows should come dealt by repartition(n, key), so that each bucket is one file.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    tables.append(path)
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def free_shuffles(spark: SparkSession) -> None:
    """Drop the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver's garbage is collected, which may be long after a large job.
    """
    gc.collect()
    spark._jvm.System.gc()
