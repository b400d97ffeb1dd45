"""Tables written between the steps of an operator.

They live below the folder that the session names in spark.checkpoint.dir, which driver and executors share, so that a
step survives the loss of any executor. Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_notes: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder of this application."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='parley-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/parley-{sc.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{root(spark)}/{re.sub(r'[^A-Za-z0-9_-]', '-', name)}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table: later steps neither recompute them nor depend on any one executor."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for made in _notes:
        made.append(path)
    return out


@contextlib.contextmanager
def noting(made: list[str]):
    """While this lasts, the paths of tables that `write_and_read` makes go into the list."""
    _notes.append(made)
    try:
        yield
    finally:
        _notes.pop()


def discard(df: DataFrame) -> None:
    """Delete a table that `write_and_read` made and nothing reads any more."""
    if path := getattr(df, "scratch_path", None):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete the table at a path of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(result=None):
    """The result, after what a worker process no longer uses has gone back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
    return result


def sweep(spark: SparkSession) -> None:
    """Let go of plans, broadcasts and shuffle files of steps that are done, on the driver and, through it, on executors.

    Executors live through all steps, and their heaps would grow to the limit; they shrink to what is in use here.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if not re.match(r"local($|\[)", spark.sparkContext.master):  # there the driver is the executor
        shrink(spark)
    tidy()


def shrink(spark: SparkSession) -> None:
    """Have the executors collect their garbage, one task for each core; their heaps give back what they need no more."""
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("collected"))
    collected.write.format("noop").mode("overwrite").save()
