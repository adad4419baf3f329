"""Session helpers shared by every job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Nothing is sent when the workers find it anyway (working directory or
    PYTHONPATH); otherwise the package goes to the executors once per context.
    """
    there = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if ROOT in map(os.path.abspath, filter(None, there)):
        return
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_sent", False):
        return
    base = os.path.join(tempfile.mkdtemp(), "loomspark")
    sc.addPyFile(shutil.make_archive(base, "zip", ROOT, "loomspark"))
    sc._loomspark_sent = True


def shared_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder.

    Where none is set, a local session takes a folder of its own, which is
    deleted at its end; on a cluster it lies in the warehouse, which is shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc.master.split("[")[0] == "local":
        path = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomspark-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._loomspark_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``stored`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._loomspark_path)


@contextmanager
def freeing(spark: SparkSession):
    """Writes within give up their shuffle files as they end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_path(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder that nothing uses yet."""
    shared_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
