"""Places in the folder that driver and executors share, and tables stored there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves a single machine; a
    cluster has to name one that all its machines share."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        held = sc._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyspan-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tallyspan-{sc.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Deletes a query's shuffle files when it has ended; without it they stay until the driver's garbage is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of the steps that are being made, the innermost last.
_steps: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("steps", default=())


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and return it re-read: its lineage ends there, so
    a lost executor costs a re-read, and its size is known to the planner. What it shuffled is
    deleted, and in an interim() the table itself goes when that ends."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    if _steps.get():
        _steps.get()[-1].append((spark, path))
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def interim() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are kept inside are deleted at its end, but those that are kept by what it gives:
    these are what the step was for, and belong to the step around it, if any."""
    held: list[tuple[SparkSession, str]] = []
    around = _steps.get()
    inside = _steps.set((*around, held))

    def result(df: DataFrame, label: str) -> DataFrame:
        here = _steps.set(around)
        try:
            return keep_rows(df, label)
        finally:
            _steps.reset(here)

    try:
        yield result
    finally:
        _steps.reset(inside)
        for spark, path in held:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def growing(df: DataFrame) -> DataFrame:
    """A frame whose rows grow with the input, joined by sorting. The planner takes the size of packed
    files for that of their rows, which is ten times as much once they are unpacked and
    exploded, and would send them whole through the driver's memory."""
    return df.hint("merge")


def keep_rows(df: DataFrame, label: str) -> DataFrame:
    """As keep, of a frame whose rows grow with the input."""
    return growing(keep(df, label))
