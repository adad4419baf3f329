"""Scalar numeric expressions."""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit against a soft target, stable for large logits."""
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def human_label(label: Column) -> Column:
    """A label of 0 or more, else null."""
    return F.when(label >= 0, label)


def human_target(label: Column) -> Column:
    """Labels of 0 or 1 on the scale of 0 to 10."""
    return F.when(label <= 1, label * 10).otherwise(label)


def threshold(x: Column) -> Column:
    return F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), x)), 1)


def learning_rate(step: Column, total: int, warmup: float, decay: float) -> Column:
    """Linear warm-up, flat, cosine tail. Step counts use round half even."""
    w, d = max(1, round(warmup * total)), max(1, round(decay * total))
    p = (step - (total - d)) / float(d)
    return F.when(step < w, (step + 1) / float(w)).when(step < total - d, 1.0).otherwise(0.5 * (1 + F.cos(F.lit(pi) * F.least(p, F.lit(1.0)))))


def learning_rate_at(step: int, total: int, warmup: float, decay: float) -> float:
    """``learning_rate`` of one step, for the driver's loop."""
    w, d = max(1, round(warmup * total)), max(1, round(decay * total))
    if step < w:
        return (step + 1) / w
    return 1.0 if step < total - d else 0.5 * (1 + cos(pi * min((step - (total - d)) / d, 1.0)))


def duration(seconds: Column) -> Column:
    """HH:MM:SS of seconds rounded half to even, not below zero; "--:--:--" if they are null or not finite."""
    x = seconds.cast("double")
    s = F.greatest(F.lit(0), F.bround(x)).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(F.isnan(x) | F.abs(x).isin(float("inf")) | x.isNull(), "--:--:--").otherwise(clock)


def time_left(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds that remain at the rate so far; null before the first step."""
    return F.when(done > 0, F.greatest(F.lit(0.0), elapsed) * F.greatest(F.lit(0), total - done) / done)


def mean_text(mean: Column) -> Column:
    """A whole mean as it is, else with one decimal; "-" without one."""
    whole = F.floor(mean) == mean
    return F.when(mean.isNull(), "-").when(whole, mean.cast("long").cast("string")).otherwise(F.format_string("%.1f", mean.cast("double")))


def rating_for_rater(v: Column) -> Column:
    """VARIANT entry: an integer rating of 0 to 10, with string explanation, quote and model."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    n = F.try_variant_get(v, "$.rating", "double")
    return F.coalesce((kind("rating") == "BIGINT") & n.between(0, 10) & (kind("explanation") == "STRING") & (kind("quote") == "STRING") & (kind("model") == "STRING"), F.lit(False))


def rating_for_training(v: Column) -> Column:
    """VARIANT entry: any finite number of 0 to 10, with a string model. The viewer takes the same ones."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    number = kind("rating").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(number & F.try_variant_get(v, "$.rating", "double").between(0, 10) & (kind("model") == "STRING"), F.lit(False))
