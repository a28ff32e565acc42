"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TASKS_PER_CORE = 16
#: Bytes of a written table, compressed, that one task takes of it.
TASK_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once per application, so that their Python finds it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spanloom-ship-"), "spanloom.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; only on one machine may that be unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> Callable[[], DataFrame]:
    """Writes the frame once, as columns, to the shared folder; each call reads it from there, with columns of its own."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/part_{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return lambda: spark.read.schema(frame.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def many_tasks(spark: SparkSession) -> int:
    """Tasks for long work on few bytes, which Spark would join into few, uneven ones that leave cores idle at the end."""
    return max(shuffle_width(spark), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out by columns, to more tasks than usual if the table that they come from is large, so that a task's memory does not grow with it."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = -(-size // TASK_BYTES)
    return rows.repartition(tasks, *by) if tasks > shuffle_width(rows.sparkSession) else rows.repartition(*by)
