"""How judges agree with each other and with people, over long ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.corpus import ordered_rank

DIGITS = 9


def scores(long: DataFrame) -> DataFrame:
    """Mean, largest and number of ratings, population variance and spread of each (row_id, filter)."""
    n, s, q = F.count("*"), F.sum("rating"), F.sum(F.col("rating") * F.col("rating"))
    x = long.groupBy("row_id", "filter").agg(n.alias("n"), s.alias("s"), q.alias("q"), F.max("rating").alias("most"), F.min("rating").alias("least"))
    mean, var = F.col("s") / F.col("n"), (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))
    return x.select("row_id", "filter", "n", F.round(mean, DIGITS).alias("mean"), F.col("most").cast("double").alias("most"), F.round(var, DIGITS).alias("variance"), (F.col("most") - F.col("least")).alias("spread"))


def high_disagreement(long: DataFrame, least: int = 5) -> DataFrame:
    return scores(long).where((F.col("n") >= 2) & (F.col("spread") >= least))


def histogram(long: DataFrame) -> DataFrame:
    """Rows by rounded mean (half up), bins 0 to 10 with the empty ones, for each filter."""
    spark = long.sparkSession
    bins = long.select("filter").distinct().crossJoin(spark.range(11).select(F.col("id").alias("bin")))
    per = scores(long).groupBy("filter", F.round("mean").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(per, ["filter", "bin"], "left").select("filter", "bin", F.coalesce("n", F.lit(0)).alias("documents"))


def correlations(long: DataFrame) -> DataFrame:
    """Pearson r of each ordered pair of models by filter; null below two pairs or without variance.

    Sums are exact for integer ratings and are divided once.
    """
    a, b = long.select("row_id", "filter", F.col("model").alias("model_a"), F.col("rating").alias("x")), long.select("row_id", "filter", F.col("model").alias("model_b"), F.col("rating").alias("y"))
    x, y = F.col("x"), F.col("y")
    per = a.join(b, ["row_id", "filter"]).groupBy("filter", "model_a", "model_b").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("xx") - sx * sx, n * F.col("yy") - sy * sy
    r = F.when((n >= 2) & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * F.col("xy") - sx * sy) / F.sqrt(vx.cast("double") * vy.cast("double")))))
    return per.select("filter", "model_a", "model_b", "n", F.round(r, DIGITS).alias("r"))


def correlation_zscores(long: DataFrame) -> DataFrame:
    """Each cell's distance from the matrix mean in population deviations; null if all are alike."""
    c = correlations(long)
    m = c.groupBy("filter").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    z = F.when(F.col("sd") > 1e-12, (F.col("r") - F.col("mean")) / F.col("sd"))
    return c.join(F.broadcast(m), "filter").select("filter", "model_a", "model_b", F.round(z, 6).alias("z"))


def model_errors(long: DataFrame, human: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Mean absolute error of each model against people, and against the mean of the other enabled models.

    ``human``: (row_id, filter, target). Models that aren't enabled get rows, but don't count as others.
    """
    on = F.lit(True) if enabled is None else F.col("model").isin(enabled)
    w = Window.partitionBy("row_id", "filter")
    x = long.withColumn("__on", on.cast("int"))
    s = F.sum(F.col("rating") * F.col("__on")).over(w) - F.col("rating") * F.col("__on")
    n = F.sum("__on").over(w) - F.col("__on")
    x = x.withColumn("__s", s).withColumn("__n", n).join(human, ["row_id", "filter"], "left")
    others = F.when(F.col("__n") > 0, F.abs(F.col("rating") - F.col("__s") / F.col("__n")))
    return x.groupBy("filter", "model").agg(
        F.count("target").alias("n_human"),
        F.round(F.avg(F.abs(F.col("rating") - F.col("target"))), 6).alias("mae_human"),
        F.count(others).alias("n_others"),
        F.round(F.avg(others), 6).alias("mae_others"),
    )


def models_by_error(errors: DataFrame) -> DataFrame:
    """``model_errors`` rows with ``place``: the smallest error against people first, models without one last."""
    w = Window.partitionBy("filter").orderBy(F.asc_nulls_last("mae_human"), "model")  # a row for each model
    return errors.withColumn("place", F.row_number().over(w).cast("long"))


def status(docs: DataFrame, long: DataFrame) -> DataFrame:
    """By filter: documents with a rating, of all documents."""
    rated = long.groupBy("filter").agg(F.countDistinct("row_id").alias("rated"))
    return rated.crossJoin(F.broadcast(docs.agg(F.count("*").alias("documents"))))  # one row


def threshold_accuracy(scored: DataFrame, human: DataFrame, at: float, score: str) -> DataFrame:
    """By filter: rows, hits, and the same among positive and negative labels; predicted if score >= at."""
    return scored.join(human, ["row_id", "filter"]).groupBy("filter").agg(*hits(F.col(score) >= at, F.col("label") >= 1))


def hits(p: Column, y: Column) -> list[Column]:
    """Counts of predictions ``p`` of labels ``y``: all, the right ones, and the same by label."""
    return [
        F.count("*").alias("n"),
        F.count_if(p == y).alias("hits"),
        F.count_if(y).alias("n_positive"),
        F.count_if((p == y) & y).alias("hits_positive"),
        F.count_if(~y).alias("n_negative"),
        F.count_if((p == y) & ~y).alias("hits_negative"),
    ]


def ranked(scored: DataFrame, by: str) -> DataFrame:
    """Rank of each row within its filter: score descending, nulls last, then row id."""
    return ordered_rank(scored, by, ["filter"], descending=True)


def page(ranks: DataFrame, selected: int, side: int = 75, whole: int = 150) -> DataFrame:
    """All rows of a filter with up to ``whole`` rows, else those near the selected rank."""
    n = ranks.groupBy("filter").agg(F.count("*").alias("__n"))
    return ranks.join(F.broadcast(n), "filter").where((F.col("__n") <= whole) | (F.abs(F.col("rank") - selected) <= side)).drop("__n")
