"""What the operators share: the cluster's shared folder, written intermediate tables, shipped code."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder, as a URI, below the one the cluster names in spark.checkpoint.dir.

    Where that is unset (tests on one machine), a temporary folder is made and set as the
    checkpoint folder. The new folder is deleted when the driver's process ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get(_SETTING, None) or sc.getConf().get(_SETTING)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="hourloom-")
        spark.conf.set(_SETTING, base)
        sc.setCheckpointDir(base)
    if "://" not in base:
        base = "file://" + base if base.startswith("/") else base
    path = f"{base}/hourloom-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reads; does nothing once the session is gone."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below a path."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffles of what is run inside at its end, not when the driver's memory happens to be collected."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, frees the shuffles behind it."""
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: texts may be long, and a worker holds a batch beside what it makes of it.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, and keep Arrow batches
    small unless the application's own settings name their size."""
    sc = spark.sparkContext
    for key, most in _BATCH.items():
        if not sc.getConf().contains(key):
            spark.conf.set(key, str(most))
    if getattr(sc, "_hourloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="hourloom-code-"), "hourloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(archive)
    sc._hourloom_shipped = True


def columns_of(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


_kept: dict[str, dict] = {}


def keep(owner: str) -> dict:
    """Where a module's tasks leave in a Python worker what its next tasks read again, until a task of another module starts there."""
    return _kept.setdefault(owner, {})


def let_go(owner: str) -> None:
    """Free what other modules' tasks have left in this worker: workers outlive an operator, and beside the next one's memory it counts twice."""
    others = [left for name, left in _kept.items() if left and name != owner]
    for left in others:
        left.clear()
    if others:
        gc.collect()  # what is left may hold itself


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, without what other operators left in the worker, and giving what Arrow's pool keeps for later
    back when the task ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        let_go(run.__module__)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable, which the optimizer never inlines."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def indices(n: Column) -> Column:
    """0 .. n-1 as an array; empty for n <= 0 or null."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
