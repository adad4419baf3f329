"""Building and auditing disjoint, de-duplicated corpora of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark import runtime

RANGE = 1000  # row ids in a step of a running sum


def first_of_each(df: DataFrame, key: str, order: str = "row_id") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def exclude(df: DataFrame, excluded: DataFrame, key: str = "digest") -> DataFrame:
    return df.join(excluded.select(key), key, "left_anti")


def running_sum(df: DataFrame, value: str, order: str = "row_id") -> DataFrame:
    """``df`` with ``cum``, the sum of ``value`` up to each row by ``order`` (a long).

    Sums of ranges of ranges of ids are added up first, then those of ranges,
    then rows within each range, so a task sees at most the millionth part of
    all ids or one range.
    """
    df = df.withColumn("__r", F.floor(F.col(order) / RANGE))
    sums = df.groupBy("__r").agg(F.sum(value).alias("__s")).withColumn("__q", F.floor(F.col("__r") / RANGE))
    tops = sums.groupBy("__q").agg(F.sum("__s").alias("__t"))
    tops = tops.select("__q", (F.sum("__t").over(Window.orderBy("__q")) - F.col("__t")).alias("__top"))
    before = F.sum("__s").over(Window.partitionBy("__q").orderBy("__r")) - F.col("__s")
    sums = sums.join(tops, "__q").select("__r", (F.col("__top") + before).alias("__base"))
    inner = Window.partitionBy("__r").orderBy(order)
    return df.join(sums, "__r").withColumn("cum", F.col("__base") + F.sum(value).over(inner)).drop("__r", "__base")


def ordered_rank(df: DataFrame, value: str, within: list[str], descending: bool = False, order: str = "row_id") -> DataFrame:
    """``df`` with ``rank`` from 1: rows of each ``within`` by value (nulls last), then ``order`` (a long).

    Values and ranges of ids get their starting ranks from their counts, and
    rows are only ordered within one range of one value, however frequent it is.
    """
    keys = [*within, "__v"]
    first = F.desc_nulls_last("__v") if descending else F.asc_nulls_last("__v")
    df = df.withColumn("__v", F.col(value)).withColumn("__r", F.floor(F.col(order) / RANGE))
    n = df.groupBy(*keys, "__r").agg(F.count("*").alias("__n"))
    tops = n.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    tops = tops.withColumn("__top", F.sum("__t").over(Window.partitionBy(*within).orderBy(first)) - F.col("__t")).drop("__t")
    n = n.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__r")) - F.col("__n")).drop("__n")

    def joined(a: DataFrame, b: DataFrame, columns: list[str], kept: str) -> DataFrame:
        b = b.select(*(F.col(c).alias(f"{c}__b") for c in columns), kept)
        on = F.lit(True)
        for c in columns:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}__b"))
        return a.join(b, on).drop(*(f"{c}__b" for c in columns))

    base = joined(n, tops, keys, "__top").withColumn("__base", F.col("__top") + F.col("__before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "__r").orderBy(order))
    out = joined(df, base, [*keys, "__r"], "__base")
    return out.withColumn("rank", (F.col("__base") + nth).cast("long")).drop("__base", "__v", "__r")


def budget_prefix(df: DataFrame, target: int, tokens: str = "token_count", order: str = "row_id") -> DataFrame:
    """Rows in order until their tokens reach the target; the row that crosses it is kept."""
    return running_sum(df, tokens, order).where(F.col("cum") - F.col(tokens) < target)


def count_prefix(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The first n rows."""
    return budget_prefix(df.withColumn("__one", F.lit(1)), n, "__one", order).drop("__one", "cum")


def require_reached(df: DataFrame, target: int, tokens: str = "token_count") -> DataFrame:
    """``df``; fails when its tokens don't reach the target."""
    total = df.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("n"))
    checked = total.select(F.when(F.col("n") < target, F.raise_error(F.lit("the source ends before the target"))).otherwise(F.lit(True)).alias("__ok"))
    return df.crossJoin(F.broadcast(checked)).where(F.col("__ok")).drop("__ok")  # one row


def reasons(df: DataFrame, excluded: DataFrame, low: int, high: int) -> DataFrame:
    """``df`` with why each row is left out: short, long, excluded, duplicate, or kept."""
    n = F.col("token_count")
    banned = excluded.select("digest").distinct().withColumn("__banned", F.lit(True))
    tagged = df.join(banned, "digest", "left").withColumn("__in", n.between(low, high) & F.col("__banned").isNull())
    first = Window.partitionBy("digest", "__in").orderBy("row_id")
    why = F.when(n < low, "short").when(n > high, "long").when(F.col("__banned"), "excluded").when(F.row_number().over(first) > 1, "duplicate").otherwise("kept")
    return tagged.withColumn("reason", why).drop("__banned", "__in")


def rejections(df: DataFrame, excluded: DataFrame, low: int, high: int, target: int) -> DataFrame:
    """(reason, documents, tokens) of the rows that a build reads until its tokens reach the target."""
    x = reasons(df, excluded, low, high).withColumn("__kept", F.when(F.col("reason") == "kept", F.col("token_count")).otherwise(0))
    x = running_sum(x, "__kept")
    return x.where(F.col("cum") - F.col("__kept") < target).groupBy("reason").agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"))


def summary(df: DataFrame) -> DataFrame:
    """Documents, tokens and surplus copies of a finished or partial corpus."""
    per = df.groupBy("digest").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    zero = F.lit(0).cast("long")
    return per.agg(F.coalesce(F.sum("n"), zero).alias("documents"), F.coalesce(F.sum("t"), zero).alias("tokens"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"))


def misaligned(output: DataFrame, source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``output`` that aren't the source's row of that row_id in ``columns`` (default: all of the source's)."""
    columns = [c for c in source.columns if c != "row_id"] if columns is None else columns
    there = source.select("row_id", F.struct(*columns).alias("__there"))
    x = output.select("row_id", F.struct(*columns).alias("__here")).join(there, "row_id", "left")
    return x.where(~F.col("__here").eqNullSafe(F.col("__there"))).select("row_id")


def extended(output: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """``output`` and the source's rows below ``n`` that it lacks; nothing past the boundary is removed."""
    more = source.where(F.col("row_id") < n).join(output.select("row_id"), "row_id", "left_anti")
    return output.unionByName(more, allowMissingColumns=True)


def audit(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Documents and tokens, and how many of them are excluded ones."""
    banned = excluded.select("digest").distinct().withColumn("__b", F.lit(1))
    x = df.join(banned, "digest", "left")
    return x.agg(
        F.count("*").alias("documents"),
        F.sum("token_count").alias("tokens"),
        F.count("__b").alias("excluded_documents"),
        F.coalesce(F.sum(F.when(F.col("__b") == 1, F.col("token_count"))), F.lit(0)).alias("excluded_tokens"),
    )


def verify_disjoint(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """The audit; fails if there is an excluded document."""
    a = audit(df, excluded)
    return a.withColumn("excluded_documents", F.when(F.col("excluded_documents") > 0, F.raise_error(F.lit("excluded documents in the corpus"))).otherwise(F.col("excluded_documents")))


def build(source: DataFrame, excluded: DataFrame, low: int, high: int, target: int, kept: DataFrame | None = None) -> DataFrame:
    """Disjoint budgeted corpus from (row_id, text, token_count, digest) rows.

    With ``kept`` (the rows of an earlier, partial build) only what is missing is
    added; it is an error if one of them is excluded.
    """
    pool = source.where(F.col("token_count").between(low, high))
    have = 0
    if kept is not None:
        if not kept.join(excluded.select("digest"), "digest", "left_semi").isEmpty():
            raise ValueError("the partial corpus holds excluded documents")
        excluded = excluded.select("digest").unionByName(kept.select("digest"))
        have = kept.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]
    pool = first_of_each(exclude(pool, excluded.distinct()), "digest")
    new = budget_prefix(pool, target - have).drop("cum")
    return new if kept is None else kept.unionByName(new)


def repair(corpus: DataFrame, source: DataFrame, excluded: DataFrame, low: int, high: int, target: int) -> DataFrame:
    """Drop excluded rows of a finished corpus and fill it up again."""
    return build(source, excluded, low, high, target, exclude(corpus, excluded.distinct()))


def with_text_keys(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``token_count`` and ``digest`` of its text, which is normalized once for both."""
    from loomspark.functions.text import normalize

    def keys(n: Column) -> Column:
        words = F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1)
        return F.struct(words.cast("long").alias("token_count"), F.sha2(n, 256).alias("digest"))

    made = df.withColumn("__keys", F.transform(F.array(normalize(text)), keys)[0])
    return made.withColumn("token_count", F.col("__keys.token_count")).withColumn("digest", F.col("__keys.digest")).drop("__keys")


def text_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, but with ``token_count`` and ``digest``, written once to the shared folder.

    Building and auditing read these few columns again and again; the texts are read once.
    """
    return runtime.stored(with_text_keys(df, F.col(text)).drop(text))


def read_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its texts normalized, and without rows that have none left."""
    from loomspark.functions.text import normalize

    return df.withColumn(text, normalize(F.col(text))).where(F.col(text) != "")
