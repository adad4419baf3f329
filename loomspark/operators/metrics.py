"""Training and validation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.corpus import ordered_rank


def probabilistic_accuracy(scored: DataFrame, p: str = "p") -> DataFrame:
    """By filter: mean probability given to the true label (0 or 1), overall and by label."""
    x = scored.where(F.col("label").isin(0, 1)).withColumn("s", F.when(F.col("label") == 1, F.col(p)).otherwise(1 - F.col(p)))
    return x.groupBy("filter").agg(
        F.count("*").alias("n"),
        F.round(F.avg("s"), 6).alias("accuracy"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.round(F.avg(F.when(F.col("label") == 1, F.col("s"))), 6).alias("accuracy_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"),
        F.round(F.avg(F.when(F.col("label") == 0, F.col("s"))), 6).alias("accuracy_negative"),
    )


def best_checkpoint(log: DataFrame) -> DataFrame:
    """The earliest step with the smallest loss."""
    return log.agg(F.min_by("step", F.struct("loss", "step")).alias("step"), F.min("loss").alias("loss"))


def moving_average(log: DataFrame, value: str, size: int = 16, series: list[str] | None = None) -> DataFrame:
    """Mean over the last ``size`` rows of each series by step.

    ``series`` names the columns that tell series apart; without it, all rows are one.
    Rows are numbered first, from counts. Series are then cut into ranges of
    these numbers, and a range also reads the ``size`` - 1 rows before it.
    """
    series = series or []
    per = max(4096, size)
    x = ordered_rank(log.withColumn("__all", F.lit(0)), "__all", series, order="step").withColumnRenamed("rank", "__n").drop("__all")
    mine, at = F.floor((F.col("__n") - 1) / per), (F.col("__n") - 1) % per
    x = x.withColumn("__r", F.explode(F.when(at >= per - size + 1, F.array(mine, mine + 1)).otherwise(F.array(mine))))
    x = x.withColumn("__own", mine == F.col("__r"))
    w = Window.partitionBy(*series, "__r").orderBy("__n").rowsBetween(-(size - 1), 0)
    return x.withColumn("average", F.avg(value).over(w)).where("__own").drop("__n", "__r", "__own")


def loss_curve(log: DataFrame, total_steps: int) -> DataFrame:
    """(step, x, y): the finite losses as points of a chart, from 0 (left, bottom) to 1.

    The loss axis reaches beyond the losses by the largest of 0.01, a tenth of
    their span and a twentieth of the largest, but not below zero.
    """
    finite = log.where(F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") != float("inf")))
    ends = finite.agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"), F.max("step").alias("last"))
    pad = F.greatest(F.lit(0.01), (F.col("hi") - F.col("lo")) * 0.1, F.col("hi") * 0.05)
    ends = ends.select(F.greatest(F.lit(0.0), F.col("lo") - pad).alias("bottom"), (F.col("hi") + pad).alias("top"), F.greatest(F.lit(1), F.lit(total_steps), "last").alias("right"))
    top = F.when(F.col("top") <= F.col("bottom"), F.col("bottom") + 0.01).otherwise(F.col("top"))
    x = F.greatest(F.lit(0), F.col("step")) / F.col("right")
    return finite.crossJoin(F.broadcast(ends)).select("step", x.alias("x"), ((F.col("loss") - F.col("bottom")) / (top - F.col("bottom"))).alias("y"))  # one row


def windowed_loss(log: DataFrame, every: int) -> DataFrame:
    """Mean loss of each full run of ``every`` steps (steps count from 1)."""
    x = log.groupBy(F.floor((F.col("step") - 1) / every).alias("window")).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"), F.max("step").alias("step"))
    return x.where(F.col("n") == every).select("window", "step", "loss")
