"""Sessions and the shared scratch area.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors share. A folder of
our own is used only where that setting is absent (tests, one machine).
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_scopes: list[list[Scratch]] = []


def local_session(cpus: int = 8, memory: str = "8g", name: str = "linkloom") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="linkloom-")
        atexit.register(folder.cleanup)
        _own_dirs[app] = f"file://{folder.name}"
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Spark removes the shuffle files of each query that is executed inside when it ends, in place of at some later collection.

    For writes: a frame that is executed again afterwards is planned anew, or makes the missing files again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing refers to any more: Spark's cleaner learns of them by a collection."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def temporary():
    """Drop at the end all scratch tables made inside: for steps whose results are written, or collected, before it."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for scratch in made:
            scratch.close()
        if spark := SparkSession.getActiveSession():
            free_shuffles(spark)


class Scratch:
    """Parquet tables in the shared folder, dropped together by ``close``.

    A written table outlives any executor, so a stage that reads one never
    recomputes what came before it, and the shuffles that made it go with the write.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)
        for scope in _scopes:
            scope.append(self)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; the cluster owns the folder
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text or binary column, counted: an optimiser's estimate says little of a frame that is more than a table."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def partitions_for(df: DataFrame, column: str, bytes_each: int) -> int:
    """Partitions that keep each near ``bytes_each`` of a column, at least the session's number."""
    return max(shuffle_partitions(df.sparkSession), math.ceil(column_bytes(df, column) / bytes_each), 1)
