"""Cutting a plan at a written table, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, which import them by name; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="veilspark-code-")) / "veilspark_modules.zip"  # the driver serves it to executors
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted([*top.rglob("*.py"), *top.rglob("*.npz")]):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df under spark.checkpoint.dir and read it back: computed once however often it is read, and safe from lost executors.

    Where the setting is missing, as in tests, a folder of our own takes its place.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/veilspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for each task of a shuffle, and the most tasks, as a shuffle's blocks grow with their square.
TASK_BYTES, MOST_TASKS = 4 << 20, 4096


def tasks_for(df: DataFrame) -> int:
    """Tasks for a shuffle of what df reads, so that a task's share stays the same as the input grows; by its files' sizes, without a job.

    Where these aren't known, the session's number.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), MOST_TASKS))
