"""Documents that arrive as a stream, filtered as in the batch build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import digest


def admitted(stream: DataFrame, excluded: DataFrame, low: int, high: int, at: str = "arrived", late: str = "1 hour") -> DataFrame:
    """Rows in the token range whose text is neither excluded nor seen before within the watermark."""
    x = stream.where(F.col("token_count").between(low, high)).withColumn("digest", digest(F.col("text")))
    x = x.join(excluded.select("digest").distinct(), "digest", "left_anti")
    return x.withWatermark(at, late).dropDuplicatesWithinWatermark(["digest"])
