"""Judge ratings in long form (row_id, filter, model, pos, rating)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["row_id", "filter", "model"]


def explode_ratings(rows: DataFrame, valid, value: str = "value") -> DataFrame:
    """Long form of VARIANT rows {ratings: {filter: [entry]}}; the last valid entry of a (filter, model) wins.

    ``valid`` is a predicate on one entry, such as those in functions.scalars.
    """
    x = rows.select("row_id", F.try_variant_get(value, "$.ratings", "variant").alias("r"))
    x = x.where(F.schema_of_variant("r").startswith("OBJECT")).lateralJoin(_entries("r", "key", "value", "f", "list"))
    x = x.where(F.schema_of_variant("list").startswith("ARRAY")).lateralJoin(_entries("list", "pos", "value", "pos", "entry"))
    x = x.where(valid(F.col("entry"))).select("row_id", F.col("f").alias("filter"), F.try_variant_get("entry", "$.model", "string").alias("model"), F.col("pos").cast("long"), F.try_variant_get("entry", "$.rating", "double").alias("rating"))
    return last_wins(x)


def _entries(column: str, a: str, b: str, as_a: str, as_b: str) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.tvf.variant_explode(F.col(column).outer()).select(F.col(a).alias(as_a), F.col(b).alias(as_b))


def last_wins(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEY).agg(F.max("pos").alias("pos"), F.max_by("rating", "pos").alias("rating"))


def promote_legacy(long: DataFrame, legacy: DataFrame, filter_name: str, model: str) -> DataFrame:
    """``long`` and the (row_id, rating) of an older field as that filter's rating where the row has none of the filter."""
    usable = legacy.where(F.col("rating").between(0, 10)).join(long.where(F.col("filter") == filter_name).select("row_id"), "row_id", "left_anti")
    return long.unionByName(usable.select("row_id", F.lit(filter_name).alias("filter"), F.lit(model).alias("model"), F.col("rating").cast("double"), F.lit(0).cast("long").alias("pos")).select(*long.columns))


def nest(long: DataFrame) -> DataFrame:
    """(row_id, ratings MAP<filter, ARRAY<STRUCT<model, rating>>>), entries by position then model."""
    lists = long.groupBy("row_id", "filter").agg(F.array_sort(F.collect_list(F.struct("pos", "model", "rating"))).alias("l"))
    lists = lists.select("row_id", "filter", F.transform("l", lambda e: F.struct(e.model.alias("model"), e.rating.alias("rating"))).alias("l"))
    return lists.groupBy("row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter", "l")))).alias("ratings"))


def pending(docs: DataFrame, layout: DataFrame, long: DataFrame) -> DataFrame:
    """(row_id, filter, model) pairs of the layout that have no rating."""
    return docs.select("row_id").crossJoin(F.broadcast(layout.select("filter", "model"))).join(long.select(*KEY), KEY, "left_anti")


def missing_stats(docs: DataFrame, layout: DataFrame, long: DataFrame) -> DataFrame:
    wanted = docs.select("row_id").crossJoin(F.broadcast(layout.select("filter", "model"))).join(long.select(*KEY).withColumn("__has", F.lit(1)), KEY, "left")
    per = wanted.groupBy("row_id").agg(F.count("*").alias("n"), F.count_if(F.col("__has").isNull()).alias("missing"))
    return per.agg(F.count_if(F.col("missing") > 0).alias("missing_documents"), F.count("*").alias("documents"), F.sum("missing").alias("missing_ratings"), F.sum("n").alias("ratings"))


def merge_missing(long: DataFrame, new: DataFrame) -> DataFrame:
    """Existing entries, and new ones where none exists."""
    return long.select(*KEY, "rating").unionByName(new.select(*KEY, "rating").join(long.select(*KEY), KEY, "left_anti"))


def overlay_stats(long: DataFrame, overlay: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts of an overlay (ann_id, filter, model) put on the rows of ``matched`` (ann_id, row_id).

    ``matched_rows`` counts the annotations that have a row, also where two have the same one.
    """
    matched = matched.where("row_id is not null")
    x = overlay.join(matched, "ann_id").select("ann_id", *KEY)
    there = long.select(*KEY).withColumn("__t", F.lit(1))
    per = x.groupBy(*KEY).agg(F.count("*").alias("n")).join(there, KEY, "left")
    added = F.col("__t").isNull().cast("long")
    totals = per.agg(F.coalesce(F.sum(added), F.lit(0)).alias("added_ratings"), F.coalesce(F.sum(F.col("n") - added), F.lit(0)).alias("collisions"))
    return totals.crossJoin(F.broadcast(matched.agg(F.count("*").alias("matched_rows"))))  # one row


def targets(docs: DataFrame, layout: DataFrame, long: DataFrame) -> DataFrame:
    """(row_id, targets): rating / 10 in layout order, null unless every pair is there."""
    n = layout.count()
    x = long.join(F.broadcast(layout), ["filter", "model"]).groupBy("row_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", (F.col("rating") / 10).alias("t")))).alias("l"))
    x = x.where(F.col("n") == n).select("row_id", F.transform("l", lambda e: e.t).alias("targets"))
    return docs.select("row_id").join(x, "row_id", "left")


def appendable(value: Column, filters: list[str]) -> Column:
    """Whether ratings can be added to a VARIANT row: its ``ratings`` is absent or an object in which each filter is absent or a list."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    whole = kind("$.ratings")
    lists = F.lit(True)
    for f in filters:
        one = kind(f"$.ratings['{f}']")
        lists = lists & (one.isNull() | one.startswith("ARRAY"))
    return whole.isNull() | (whole.startswith("OBJECT") & lists)


def require_appendable(rows: DataFrame, filters: list[str], value: str = "value") -> DataFrame:
    """``rows``; fails on one to which ratings can't be added, so nothing in it is replaced."""
    bad = F.raise_error(F.concat(F.lit("ratings can't be added to row "), F.col("row_id").cast("string"))).cast("boolean")
    return rows.where(F.when(appendable(F.col(value), filters), F.lit(True)).otherwise(bad))
