"""Finding hand-labelled texts among corpus rows: by whole text, else by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.functions.text import PREFIX, prefix


def match(hand: DataFrame, corpus: DataFrame, exact_last: bool = False, chars: int = PREFIX) -> DataFrame:
    """(ann_id, row_id, how) of each (ann_id, text): how is exact, prefix, or null.

    The first corpus row of a text or prefix is taken; with ``exact_last`` the
    last one of a text.
    """
    pick = F.max if exact_last else F.min
    whole = corpus.groupBy(F.sha2("text", 256).alias("__k")).agg(pick("row_id").alias("__e"))
    start = corpus.groupBy(F.sha2(prefix(F.col("text"), chars), 256).alias("__p")).agg(F.min("row_id").alias("__s"))
    x = hand.withColumn("__k", F.sha2("text", 256)).withColumn("__p", F.sha2(prefix(F.col("text"), chars), 256)).join(whole, "__k", "left").join(start, "__p", "left")
    how = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__s").isNotNull(), "prefix")
    return x.select("ann_id", F.coalesce("__e", "__s").alias("row_id"), how.alias("how"))


def all_matches(hand: DataFrame, corpus: DataFrame, chars: int = PREFIX) -> DataFrame:
    """Every corpus row with the text or the prefix of a hand text."""
    keys = hand.select(F.sha2(prefix(F.col("text"), chars), 256).alias("__p")).distinct()
    return corpus.withColumn("__p", F.sha2(prefix(F.col("text"), chars), 256)).join(keys, "__p", "left_semi").select("row_id").distinct()


def first_labels(matched: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of each matched row: those of its first annotation."""
    x = matched.where("row_id is not null").groupBy("row_id").agg(F.min("ann_id").alias("ann_id"))
    return x.join(labels, "ann_id")


def clashes(matched: DataFrame) -> DataFrame:
    """Rows that more than one annotation matches."""
    return matched.where("row_id is not null").groupBy("row_id").agg(F.count("*").alias("annotations")).where("annotations > 1")


def require_unique(matched: DataFrame) -> DataFrame:
    """``matched``; fails on an unmatched annotation or two on one row."""
    bad = matched.where("row_id is null").select(F.lit(1).alias("x")).unionByName(clashes(matched).select(F.lit(1).alias("x"))).agg(F.count("*").alias("n"))
    ok = bad.select(F.when(F.col("n") > 0, F.raise_error(F.lit("annotations without a row of their own"))).otherwise(F.lit(True)).alias("__ok"))
    return matched.crossJoin(F.broadcast(ok)).where("__ok").drop("__ok")  # one row


def synced(annotations: DataFrame, live: DataFrame, chars: int = PREFIX) -> DataFrame:
    """``annotations`` (ann_id, text, ...) with the live rows' texts, ``row_id`` and ``how``.

    Each must be found among the (row_id, text) of ``live``, by whole text or
    else by prefix, and no two on one row; an error names up to ten that aren't.
    """
    found = runtime.stored(match(annotations.select("ann_id", "text"), live, chars=chars))
    lost = [r.ann_id for r in found.where("row_id is null").orderBy("ann_id").limit(10).collect()]
    if lost:
        raise ValueError(f"annotations without a live row: {', '.join(map(str, lost))}")
    twice = [r.row_id for r in clashes(found).orderBy("row_id").limit(10).collect()]
    if twice:
        raise ValueError(f"live rows with several annotations: {', '.join(map(str, twice))}")
    return annotations.drop("text", "row_id", "how").join(found, "ann_id").join(live.select("row_id", "text"), "row_id").select("ann_id", "row_id", "how", "text", *(c for c in annotations.columns if c not in ("ann_id", "row_id", "how", "text")))


def sync_counts(synced: DataFrame) -> DataFrame:
    """(exact, prefix): how the annotations were found."""
    return synced.agg(F.count_if(F.col("how") == "exact").alias("exact"), F.count_if(F.col("how") == "prefix").alias("prefix"))
