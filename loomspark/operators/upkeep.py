"""Keeping a rated table up to date: patches, refreshes, batches and resumed scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.operators.corpus import ordered_rank
from loomspark.sources import versions


def patched(rows: DataFrame, replacements: DataFrame, key: str = "row_id") -> DataFrame:
    """``rows`` with those of ``replacements`` in place of the ones with their key; other keys of it are left out."""
    there = replacements.join(rows.select(key), key, "left_semi").select(rows.columns)
    return rows.join(replacements.select(key), key, "left_anti").unionByName(there)


def refreshed(rows: DataFrame, column: str = "ratings") -> DataFrame:
    """``rows`` without any rating, with ``cleared``: whether the row had some."""
    return rows.withColumn("cleared", F.col(column).isNotNull()).withColumn(column, F.lit(None).cast(rows.schema[column].dataType))


def outcome(asked: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """(saved, failed): of the pairs asked for, those that have an answer and those that don't."""
    x = asked.select(*key).join(got.select(*key).distinct().withColumn("__got", F.lit(True)), key, "left")
    return x.agg(F.count("__got").alias("saved"), F.count_if(F.col("__got").isNull()).alias("failed"))


def examples(**sets: DataFrame) -> DataFrame:
    """All rows of several sets, repeats included, with ``origin`` and ``example_id``: origin and line, unique across sets."""
    out = None
    for name, rows in sets.items():
        rows = rows.withColumn("origin", F.lit(name)).withColumn("example_id", F.concat(F.lit(f"{name}:"), F.col("line").cast("string")))
        out = rows if out is None else out.unionByName(rows)
    return out


def by_batches(rows: DataFrame, path: str, size: int, work: Callable[[DataFrame], DataFrame], key: str = "row_id", compact_after: int = 64) -> str:
    """Patch the table under ``path`` with ``work`` of ``rows``, ``size`` rows at a time by key; returns the version.

    Rows are ranked once and stored by batch, so a batch reads its own rows
    only, and what ``work`` returns is added as a delta: what is written grows
    with the batch, not with the table. Each batch is committed before the next
    one begins, with the count of finished batches in the table's state, so an
    interruption loses one batch at most. After ``compact_after`` deltas the
    table is put together again.
    """
    spark = rows.sparkSession
    ranked = ordered_rank(rows.withColumn("__all", F.lit(0)), "__all", [], order=key).drop("__all")
    ranked = ranked.withColumn("__batch", F.floor((F.col("rank") - 1) / size)).drop("rank")
    home = runtime.new_path(spark)
    ranked.repartition("__batch").write.partitionBy("__batch").parquet(home)
    numbers = [r["__batch"] for r in spark.read.parquet(home).groupBy("__batch").count().select("__batch").sort("__batch").collect()] if rows.columns else []
    at = versions.version(spark, path)
    for done, k in enumerate(numbers, 1):
        new = work(spark.read.schema(rows.schema).parquet(f"{home}/__batch={k}"))
        at = versions.commit(new, path, at, "upsert", [key], {"batches": len(numbers), "completed_batches": done})
        if len(versions.manifest(spark, path, at)["parts"]) > compact_after:
            at = versions.compact(spark, path)
    runtime.delete(spark, home)
    return at


def fingerprint(batched: DataFrame, **settings) -> str:
    """What a scoring run depends on: its rows, their lengths and its settings."""
    rows = batched.agg(F.count("*").alias("n"), F.sum(F.xxhash64("row_id", "token_count").cast("decimal(38,0)")).alias("s")).first()
    return "|".join([str(rows.n), str(rows.s), *(f"{k}={settings[k]}" for k in sorted(settings))])


def remaining(batched: DataFrame, scored: DataFrame, saved: str, now: str) -> DataFrame:
    """Batches of which a row has no score yet; an error unless the saved run's fingerprint is this one's."""
    if saved != now:
        raise ValueError("the saved scores belong to other rows or settings; start again")
    return batched.join(scored.select("row_id"), "row_id", "left_anti").select("batch").distinct()


def documents_done(batched: DataFrame, batches: DataFrame) -> DataFrame:
    """(documents): rows of the finished ``batches``."""
    return batched.join(batches.select("batch"), "batch", "left_semi").agg(F.count("*").alias("documents"))


def rows_of_batch(source: DataFrame, batched: DataFrame, batch: int) -> DataFrame:
    """The source's rows of one batch."""
    return source.join(batched.where(F.col("batch") == batch).select("row_id"), "row_id", "left_semi")
