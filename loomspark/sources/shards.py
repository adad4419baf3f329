"""Parquet shards in a fixed order, and sources of which the first usable one counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files under ``path`` (a folder, a file or a pattern) by path, without hidden ones."""
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], list(fs.globStatus(home) or [])
    while todo:
        f = todo.pop()
        if f.getPath().getName().startswith(("_", ".")):
            continue
        if f.isDirectory():
            todo += list(fs.listStatus(f.getPath()))
        elif f.getPath().getName().endswith(suffix):
            found.append(f.getPath().toString())
    return sorted(found)


def read_shards(spark: SparkSession, path: str | list[str], columns: list[str], start: int = 0) -> DataFrame:
    """``columns`` of the Parquet files under ``path`` with ``row_id`` from ``start``, by file path and then row.

    Fails if there is no file or a column is missing. Only the columns are read;
    files get their first ids from their row counts.
    """
    files = spark.read.parquet(*([path] if isinstance(path, str) else path))
    missing = [c for c in columns if c not in files.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    rows = files.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    n = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    base = n.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n") + start).alias("__base"))  # a row for each file
    return rows.join(base, "__file").select((F.col("__base") + F.col("__row")).alias("row_id"), *columns)


def first_usable(reads: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read and has a row; if none has, an error that names what was wrong with each."""
    errors = []
    for k, read in enumerate(reads):
        try:
            df = read()
            if not df.isEmpty():
                return df
            errors.append(f"source {k} is empty")
        except Exception as e:  # any failure means the next source
            errors.append(f"source {k}: {str(e).splitlines()[0]}")
    raise ValueError("; ".join(errors) or "no source")
