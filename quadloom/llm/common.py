"""Shared plumbing of the training-data operators.

Tables that a job reads twice are written to the folder all machines share
(``spark.checkpoint.dir``), never to a machine's own disk, so a lost executor
costs a re-read and not a re-run. What a result no longer needs is deleted.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_REPO = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}
#: Bytes of the tables behind a plan for each task that writes its result.
PER_TASK = 4 << 20
#: Bytes that Spark hands to a Python worker at once, where a job goes through several operators.
BATCH = 8 << 20
_HOLDER: list = ["", lambda: None]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started elsewhere."""
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_REPO, env.get("PYTHONPATH", "")) if x)


def holds(name: str, drop: Callable[[], object] = lambda: None) -> None:
    """Called in a Python worker by the operator ``name``: what another one kept there from task to task is dropped, and its memory given back.

    Workers outlive an operator, so each would keep the memos of all the operators of a job. ``drop`` empties the caller's own.
    """
    if _HOLDER[0] != name:
        _HOLDER[1]()
        _HOLDER[:] = name, drop
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not glibc


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of ``BATCH`` bytes at most: an executor has each batch several times, in the JVM and in each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, f"{BATCH}b")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and driver and executors share a machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quadloom-")
            atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), ignore_errors=True)
        given = _OWN[app]
    return given.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quadloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def sized(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` in no more partitions than the tables behind it call for: one for ``PER_TASK`` bytes of them, ``least`` (the cluster's cores) at least.

    A shuffle has as many partitions as the session says, and each with rows becomes a file. On a local file system Hadoop
    starts a process three times for each file, so a few rows in hundreds of files cost more than all else about them.
    For plans whose last stage is light; one whose tables have no known size stays as it is.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    tasks = max(least or df.sparkSession.sparkContext.defaultParallelism, -(-size // PER_TASK))
    return df.coalesce(tasks) if tasks < 1 << 31 else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The folder stays as long as something may read it: until ``remove``, or ``clear`` at the job's end.
    """
    return _staged(df, fresh_dir(df.sparkSession, name))


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged; no DataFrame of these operators can be read afterwards."""
    remove(spark, f"{shared_dir(spark)}/quadloom/{spark.sparkContext.applicationId}")


class Scratch:
    """Staged tables that are deleted when the block ends; those of ``keep`` stay for the result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_dir(self.spark, name))
        return _staged(df, self.paths[-1])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name)

    def drop_all_but(self, last: int) -> None:
        """Delete what was staged before the last tables."""
        for path in self.paths[:-last]:
            remove(self.spark, path)
        self.paths = self.paths[-last:]

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def free_name(base: str, taken: list[str]) -> str:
    """A column name that is not among ``taken``, whatever their case."""
    known = {c.lower() for c in taken}
    while base.lower() in known:
        base = f"_{base}"
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
