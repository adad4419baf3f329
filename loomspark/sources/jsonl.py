"""JSON lines with an explicit policy for lines that aren't usable, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import human_label


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of every physical line, from 1.

    Files are read in splits of any number; a split's first line number is the
    count of lines in the splits before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"))
    n = rows.groupBy("file", "at").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    start = n.select("file", "at", (before - F.col("first") + 1).alias("shift"))
    return rows.join(F.broadcast(start), ["file", "at"]).select("file", (F.col("nth") + F.col("shift")).alias("line"), "text")  # start has a row for each split


def read_jsonl(spark: SparkSession, path: str | list[str], policy: str = "fail", blank_lines: bool = True) -> DataFrame:
    """(file, line, value VARIANT) of each non-blank line that holds an object.

    ``fail``: any other non-blank line is an error; ``skip``: it is left out;
    ``count``: it stays with a null value. ``line`` is the 1-based physical line
    within its file. Blank lines are left out, or treated as unusable ones
    unless ``blank_lines``.
    """
    rows = _lines(spark, path)
    if blank_lines:
        rows = rows.where(~F.col("text").rlike(r"^\s*$"))
    value = F.try_parse_json("text")
    good = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    if policy == "skip":
        return rows.where(good).select("file", "line", value.alias("value"))
    if policy == "count":
        return rows.select("file", "line", F.when(good, value).alias("value"))
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("file"), F.lit(":"), F.col("line")))
    return rows.select("file", "line", F.when(good, value).otherwise(bad.cast("variant")).alias("value"))


def with_row_id(rows: DataFrame) -> DataFrame:
    """``rows`` of read_jsonl with ``row_id`` from 0 over the usable rows, by file and line."""
    n = rows.withColumn("__r", F.floor(F.col("line") / 1000)).groupBy("file", "__r").agg(F.count("*").alias("__n"))
    per_file = n.groupBy("file").agg(F.sum("__n").alias("__t"))
    per_file = per_file.select("file", (F.sum("__t").over(Window.orderBy("file")) - F.col("__t")).alias("__top"))  # a row for each file
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__r")) - F.col("__n")
    base = n.withColumn("__before", before).join(per_file, "file").select("file", "__r", (F.col("__top") + F.col("__before")).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("file", "__r").orderBy("line")) - 1
    x = rows.withColumn("__r", F.floor(F.col("line") / 1000)).join(base, ["file", "__r"])
    return x.withColumn("row_id", (F.col("__base") + nth).cast("long")).drop("__r", "__base")


def string_field(name: str, empty: bool = True):
    """A field that must be a string (and, unless ``empty``, not an empty one); else null."""
    v = F.try_variant_get("value", f"$.{name}", "variant")
    s = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("value", f"$.{name}", "string"))
    return s if empty else F.nullif(s, F.lit(""))


def positive_int_field(name: str, most: int = 2**32 - 1):
    """A field that must be a JSON integer from 1 to ``most`` (no bool, no 3.0, no string); else null."""
    v = F.try_variant_get("value", f"$.{name}", "variant")
    n = F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get("value", f"$.{name}", "bigint"))
    return F.when(n.between(1, most), n)


def label_field(name: str):
    """A human label: a JSON integer of 0 or more (no bool, no 1.0); else null."""
    v = F.try_variant_get("value", f"$.{name}", "variant")
    return human_label(F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get("value", f"$.{name}", "bigint")))


def read_annotations(spark: SparkSession, path: str, labels: dict[str, str], blank_lines: bool = True) -> DataFrame:
    """(line, text, and a column for each filter) of hand-annotated rows; ``labels``: filter -> field.

    A line that isn't an object with a text that isn't empty is an error that
    names it, and so is a file without rows; with ``blank_lines`` False, as for
    rows that must stay aligned, a blank line too. Labels that aren't whole
    numbers of 0 or more are null.
    """
    rows = read_jsonl(spark, path, "fail", blank_lines)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    text = string_field("text", empty=False)
    missing = F.raise_error(F.concat(F.lit("no text: "), F.col("file"), F.lit(":"), F.col("line"))).cast("string")
    return rows.select("line", F.coalesce(text, missing).alias("text"), *(label_field(field).alias(name) for name, field in labels.items()))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Compact JSON lines; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_live_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row_id, text, value) of rows that must stay aligned with their lines, row_id from 0.

    A blank line, one that isn't an object with a text that isn't empty, and a
    file without rows are errors.
    """
    rows = read_jsonl(spark, path, "fail", blank_lines=False)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    missing = F.raise_error(F.concat(F.lit("no text: "), F.col("file"), F.lit(":"), F.col("line"))).cast("string")
    return with_row_id(rows).select("row_id", F.coalesce(string_field("text", empty=False), missing).alias("text"), "value")


def replace_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON lines in place of what is at ``path``.

    The lines are written beside it first. If that or the move fails, what was
    there is there again.
    """
    spark = df.sparkSession
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home.getParent(), f"_{home.getName()}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    try:
        write_jsonl(df, new.toString())
        moved = not fs.exists(home) or fs.rename(home, old)
        if not moved or not fs.rename(new, home):
            raise RuntimeError(f"{path} couldn't be replaced")
        fs.delete(old, True)
    except BaseException:
        if fs.exists(old) and not fs.exists(home):
            fs.rename(old, home)
        fs.delete(new, True)
        raise
