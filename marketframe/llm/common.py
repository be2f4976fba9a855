"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the controls 9 to 13. ``bytes.split()`` has the same set.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of an Arrow batch.
BATCH = "2m"
#: Whether Spark removes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small in bytes: texts may be long and rows many."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":  # Spark's own value; a session's choice stays
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session that names none (tests) gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="marketframe-"))
        folder = context.getCheckpointDir()
    return folder


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and go on from the files.

    The files outlive any executor, and what follows does not compute ``df`` again. The shuffle
    files behind ``df`` are removed once it is written, as nothing reads them any more.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*settled: DataFrame) -> None:
    """Remove the files of tables made by ``settle``, once all that reads them has been written."""
    for df in settled:
        java = df.sparkSession._jvm
        files = [java.org.apache.hadoop.fs.Path(java.java.net.URI.create(f)) for f in df.inputFiles()]
        for folder in {f.getParent().toString(): f.getParent() for f in files}.values():
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and Spark runs several beside its own heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library is glibc
    if trim:
        trim(0)


def gives_back(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that gives its memory back once it has ended and its own data is gone."""

    @wraps(work)
    def run(*batches: Iterator) -> Iterator:
        yield from work(*batches)
        give_back()

    return run


def raw(text: Column | str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")
