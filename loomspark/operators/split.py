"""Validation split and weighted replication of training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.functions.permute import permuted
from loomspark.operators import matching, ratings
from loomspark.operators.corpus import count_prefix, running_sum


def sample_size(n: int, fraction: float) -> int:
    """Rounded half to even; at least 1 of 2 or more rows when a part is asked for."""
    k = round(n * fraction)
    return max(k, 1) if fraction > 0 and n > 1 else k


def hash_rank(seed: int, row_id: str = "row_id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")), 256)


def hash_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The k rows with the smallest hash of seed and row id.

    The hash's first 32 bits order ranges, in which the whole hash decides.
    """
    k = sample_size(df.count(), fraction)
    h = df.withColumn("__h", hash_rank(seed))
    by = h.withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("long"))
    per = running_sum(by.groupBy("__b").agg(F.count("*").alias("__n")), "__n", "__b").select("__b", (F.col("cum") - F.col("__n")).alias("__before"), "cum")
    x = by.join(F.broadcast(per), "__b")  # at most 65,536 rows
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("__b").orderBy("__h"))
    whole = x.where(F.col("cum") <= k)
    edge = x.where((F.col("__before") < k) & (F.col("cum") > k)).withColumn("__i", F.col("__before") + nth).where(F.col("__i") <= k).drop("__i")
    return whole.unionByName(edge).drop("__h", "__b", "__before", "cum")


def exact_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """As many rows as ``sample_size`` says: those that a seeded permutation of the rows by id puts first.

    Each row computes its own place, so nothing is drawn on the driver.
    """
    n = df.count()
    x = running_sum(df.withColumn("__one", F.lit(1).cast("long")), "__one")
    return x.where(permuted(F.col("cum") - 1, n, seed) < sample_size(n, fraction)).drop("__one", "cum")


def upsample_weights(long: DataFrame, weights: dict[str, int], least: int = 2) -> DataFrame:
    """(row_id, weight): the largest weight among filters with a mean rating of ``least`` or more, else 1.

    The test is on integer sums, so it doesn't depend on the order of addition.
    """
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    per = long.groupBy("row_id", "filter").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    return per.groupBy("row_id").agg(F.coalesce(F.max(F.when(F.col("s") >= least * F.col("n"), F.try_element_at(w, F.col("filter")))), F.lit(1)).cast("long").alias("weight"))


def replicate(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Each row as often as its weight says, with its copy number from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(weight))))


@dataclass
class Prepared:
    """Rows to train on (one for each copy) and to validate on, the labels of the latter, and the counts of all of it."""

    train: DataFrame  # row_id, targets, weight, copy
    validation: DataFrame  # origin (hand or rated), row_id, targets
    labels: DataFrame  # row_id of a hand row, and the labels of its first annotation
    summary: DataFrame  # name, n


def prepare(docs: DataFrame, long: DataFrame, hand_docs: DataFrame, hand_long: DataFrame, annotations: DataFrame, layout: DataFrame, weights: dict[str, int], fraction: float = 0.05, seed: int = 7) -> Prepared:
    """Training and validation rows from rated documents, rated hand documents and hand annotations.

    ``docs`` and ``hand_docs`` are (row_id, text), ``long`` and ``hand_long``
    their ratings, ``annotations`` (ann_id, text, labels). Rows without every
    rating of the layout are left out. No row whose text or prefix is that of a
    hand document or annotation is trained on. All complete hand rows and a
    sample of the others are for validation; training rows are repeated by weight.
    """
    complete = runtime.stored(ratings.targets(docs, layout, long))
    by_hand = runtime.stored(ratings.targets(hand_docs, layout, hand_long))
    usable, hand = complete.where("targets is not null"), by_hand.where("targets is not null")
    if usable.isEmpty() or hand.isEmpty():
        raise ValueError("no rated, or no hand, row has every rating of the layout")
    texts = annotations.select("text").unionByName(hand_docs.select("text")).withColumn("ann_id", F.monotonically_increasing_id())
    overlap = runtime.stored(matching.match(texts, docs).where("row_id is not null").select("row_id").distinct())
    eligible = runtime.stored(usable.join(overlap, "row_id", "left_anti"))
    if eligible.isEmpty():
        raise ValueError("every complete row is a hand document too")
    sample = runtime.stored(hash_sample(eligible.select("row_id"), fraction, seed))
    train = eligible.join(sample, "row_id", "left_anti")
    if train.isEmpty():
        raise ValueError("the validation rows leave none to train on")
    weighted = runtime.stored(train.join(upsample_weights(long, weights), "row_id"))
    found = runtime.stored(matching.match(annotations.select("ann_id", "text"), hand_docs))
    labels = matching.first_labels(found, annotations.drop("text")).join(hand.select("row_id"), "row_id", "left_semi")
    validation = hand.withColumn("origin", F.lit("hand")).unionByName(eligible.join(sample, "row_id", "left_semi").withColumn("origin", F.lit("rated"))).select("origin", "row_id", "targets")
    size = lambda df: df.agg(F.count("*").alias("n"))
    one = complete.agg(F.count("*").alias("rated_rows"), F.count("targets").alias("complete_rows"))
    two = by_hand.agg(F.count("*").alias("hand_rows"), F.count("targets").alias("validation_hand_rows"))
    three = weighted.agg(F.count("*").alias("unique_training_rows"), F.sum("weight").alias("training_rows"), F.count_if(F.col("weight") > 1).alias("upsampled_rows"))
    four = size(overlap.join(usable, "row_id", "left_semi")).withColumnRenamed("n", "excluded_overlap_rows")
    five = size(sample).withColumnRenamed("n", "validation_sample_rows")
    six = found.agg(F.count_if(F.col("row_id").isNull()).alias("unmatched_annotations"))
    seven = size(layout).withColumnRenamed("n", "targets")
    all_of = one
    for part in (two, three, four, five, six, seven):
        all_of = all_of.crossJoin(F.broadcast(part))  # one row each
    c = F.col
    all_of = (
        all_of.withColumn("incomplete_rows", c("rated_rows") - c("complete_rows"))
        .withColumn("duplicate_copies", c("training_rows") - c("unique_training_rows"))
        .withColumn("validation_rows", c("validation_hand_rows") + c("validation_sample_rows"))
        .withColumn("unusable_hand_rows", c("unmatched_annotations") + c("hand_rows") - c("validation_hand_rows"))
    )
    summary = all_of.unpivot([], all_of.columns, "name", "n")
    return Prepared(replicate(weighted), validation, labels, summary)


__all__ = ["count_prefix", "exact_sample", "hash_sample", "Prepared", "prepare", "replicate", "sample_size", "upsample_weights"]
