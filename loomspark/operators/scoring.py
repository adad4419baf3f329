"""Scoring documents with a model, in batches of like length, and the tags made of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.permute import permuted
from loomspark.functions.scalars import sigmoid
from loomspark.operators.corpus import ordered_rank


def length_batches(df: DataFrame, size: int) -> DataFrame:
    """``df`` with ``rank`` and ``batch``: rows by token_count, then row_id, in runs of ``size``.

    Ranks start from 0 and come from counts, so no task orders all rows of a length.
    """
    x = ordered_rank(df, "token_count", []).withColumn("rank", F.col("rank") - 1)
    return x.withColumn("batch", F.floor(F.col("rank") / size).cast("long"))


def padding_waste(batched: DataFrame) -> DataFrame:
    """Tokens, and tokens when each batch is padded to its longest row."""
    per = batched.groupBy("batch").agg(F.sum("token_count").alias("t"), (F.max("token_count") * F.count("*")).alias("p"))
    return per.agg(F.sum("t").alias("tokens"), F.sum("p").alias("padded_tokens"))


def batch_order(spark, batches: int, seed: int) -> DataFrame:
    """(position, batch): the batches in an order that the seed decides; each computes its own position."""
    return spark.range(batches).select(permuted(F.col("id"), batches, seed).alias("position"), F.col("id").alias("batch"))


def linear_head(vector: Column, weights: Column) -> Column:
    """Dot product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(vector, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def score_with(df: DataFrame, load: Callable[[], Callable], n_targets: int) -> DataFrame:
    """(row_id, probs) by a model that ``load`` makes once for each task; it maps a list of texts to probabilities.

    Rows are sorted by length within each partition, so batches pad little.
    """

    def run(batches):
        import pandas as pd

        model = load()
        for b in batches:
            p = model(b["text"].tolist())
            assert all(len(x) == n_targets for x in p)
            yield pd.DataFrame({"row_id": b["row_id"], "probs": [[float(y) for y in x] for x in p]})

    return df.select("row_id", "text", "token_count").sortWithinPartitions("token_count").drop("token_count").mapInPandas(run, "row_id long, probs array<float>")


def layout_of(names: list[str]) -> list[tuple[int, str, str]]:
    """(index, filter, judge) of "filter::judge" names; each filter must have the same judges in the same order."""
    parts = [n.split("::", 1) for n in names]
    if not parts or any(len(p) != 2 or not all(p) for p in parts):
        raise ValueError("target names must be filter::judge")
    judges: dict[str, list[str]] = {}
    for f, j in parts:
        judges.setdefault(f, []).append(j)
    first = next(iter(judges.values()))
    if len(set(first)) != len(first) or any(j != first for j in judges.values()):
        raise ValueError("each filter must have the same judges, each once and in one order")
    return [(k, f, j) for k, (f, j) in enumerate(parts)]


def fit_linear_head(rows: DataFrame, size: int, steps: int = 50, rate: float = 1.0) -> list[float]:
    """Weights of a bias-free logistic head on frozen (vector, target in 0 to 1) rows.

    Each step is one full-batch gradient, summed by Spark; only ``size`` sums
    reach the driver. The weights start at zero.
    """
    w = [0.0] * size
    rows = rows.where(F.col("vector").isNotNull() & F.col("target").isNotNull())
    for _ in range(steps):
        logit = linear_head(F.col("vector"), F.array(*map(F.lit, w)))
        off = rows.select("vector", (sigmoid(logit) - F.col("target")).alias("e"))
        sums = off.agg(F.count("*").alias("n"), *(F.sum(F.col("e") * F.get("vector", F.lit(d))).alias(f"g{d}") for d in range(size))).first()
        if not sums["n"]:
            break
        w = [x - rate * (sums[f"g{d}"] or 0.0) / sums["n"] for d, x in enumerate(w)]
    return w


def nest_tags(long: DataFrame) -> DataFrame:
    """(row_id, tags MAP<filter, MAP<judge, p>>) of (row_id, filter, judge, p); fails on p outside 0 to 1."""
    bad = F.isnan("p") | ~F.col("p").between(0, 1)
    x = long.withColumn("p", F.when(bad | F.col("p").isNull(), F.raise_error(F.lit("not a probability")).cast("double")).otherwise(F.col("p")))

    def by_name(a: Column, b: Column) -> Column:
        return F.when(a["filter"] < b["filter"], -1).when(a["filter"] > b["filter"], 1).otherwise(0)

    inner = x.groupBy("row_id", "filter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge", "p")))).alias("m"))
    return inner.groupBy("row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter", "m")), by_name)).alias("tags"))


def tags_valid(tags: Column, layout: dict[str, list[str]]) -> Column:
    """Exactly the layout's filters and judges, each with a finite number of 0 to 1."""
    ok = F.sort_array(F.map_keys(tags)) == F.array(*(F.lit(f) for f in sorted(layout)))
    for f, judges in layout.items():
        m = F.try_element_at(tags, F.lit(f))
        ok = ok & (F.sort_array(F.map_keys(m)) == F.array(*(F.lit(j) for j in sorted(judges)))) & F.forall(F.map_values(m), lambda p: ~F.isnan(p) & p.between(0, 1))
    return F.coalesce(ok, F.lit(False))


def filter_means(long: DataFrame) -> DataFrame:
    return long.groupBy("row_id", "filter").agg(F.round(F.avg("p"), 6).alias("p"))


def probabilities(logits: DataFrame) -> DataFrame:
    """Logits as probabilities of single precision, as they are stored."""
    return logits.withColumn("p", sigmoid(F.col("logit")).cast("float").cast("double"))
