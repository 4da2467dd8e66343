"""Where intermediate tables live, so that a lost executor never takes results with it."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset and all tasks run in the driver
    (tests on one machine) a fresh local folder is chosen once per session; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.bandframe.scratch", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-bandframe-")
        spark.conf.set("spark.bandframe.scratch", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/bandframe/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark deletes the shuffle files of an action as soon as that ends.

    Else they stay until the driver happens to collect its garbage. Only for actions that end here, such as
    ``cut``: an iterator over rows reads them later.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(steps: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator of a task that gives freed memory back when it ends."""

    @wraps(steps)
    def run(*args: object, **more: object) -> Iterator:
        yield from steps(*args, **more)
        give_back()

    return run


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most so many rows to Python at a time, from now on in this session.

    With Spark's 10,000 rows a batch of long texts takes hundreds of MB, several times over.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def wide_groups(spark: SparkSession, groups: int = 20_000) -> None:
    """Let an aggregation of lists keep so many groups in memory before it sorts its input, from now on.

    Spark's 128 would sort every edge of every word, although those of a word come together.
    """
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    spark.conf.set(key, max(groups, int(spark.conf.get(key))))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns asked for of the whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))
