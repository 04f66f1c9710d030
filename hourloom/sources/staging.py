"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


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


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """The table, computed once and read as often as the plan after it needs."""
    return materialize(df, shared_dir(df.sparkSession))
