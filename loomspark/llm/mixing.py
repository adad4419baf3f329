"""Mixing sources to target weights by temperature (DataFrame functions only).

A source with share s of all tokens gets a weight in proportion to s**a. The
exponent a is bisected between 0 (all sources alike) and 1 (as they stand) to
meet a target entropy, a repetition limit, or both. The weights are then
realised: a source gives whole blocks, each a permutation of all its documents,
and one last block that is cut where its token budget ends.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark import runtime

MOST_SOURCES = 100_000  # the table of sources is handled on the driver up to this many
PER_BUCKET = 4096  # documents of a source in a step of the last block's running sum
_MIN = -(1 << 63)


def weights_at(shares: list[float], a: float) -> list[float]:
    raw = [s**a if s > 0 else 0.0 for s in shares]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def entropy(weights: list[float]) -> float:
    return -sum(w * log(w) for w in weights if w > 0)


def bisect_exponent(shares: list[float], fits) -> float:
    """The smallest exponent in [0, 1] whose weights fit, if fitting weights lie above it."""
    if fits(weights_at(shares, 0.0)):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if fits(weights_at(shares, mid)):
            high = mid
        else:
            low = mid
    return high


def plan(sizes: dict, budget: int | None, target_entropy: float | None, max_epochs: float | None, keep_all: bool) -> dict:
    """{source: tokens to give}.

    ``target_entropy`` is a share of the entropy of equal weights. With
    ``keep_all`` the budget is what gives each source at least one whole block.
    """
    sources = [s for s in sizes if sizes[s] > 0]
    if not sources:
        return {}
    total = sum(sizes[s] for s in sources)
    shares = [sizes[s] / total for s in sources]

    def tokens(w: list[float]) -> list[float]:
        b = max(sizes[s] / x for s, x in zip(sources, w, strict=True)) if keep_all else (total if budget is None else budget)
        return [b * x for x in w]

    a = 0.0 if target_entropy is not None or max_epochs is not None else 1.0
    if target_entropy is not None:
        a = max(a, bisect_exponent(shares, lambda w: entropy(w) <= target_entropy * log(max(2, len(sources)))))
    if max_epochs is not None:
        a = max(a, bisect_exponent(shares, lambda w: all(t <= max_epochs * sizes[s] * (1 + 1e-9) for s, t in zip(sources, tokens(w), strict=True))))
    given = tokens(weights_at(shares, a))
    return {s: max(round(t), sizes[s] if keep_all else 0) for s, t in zip(sources, given, strict=True)}


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: int | None = None,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    keep_all: bool = False,
    seed: int = 0,
) -> DataFrame:
    """One row for each copy of a document in the mix.

    Adds ``epoch`` (the block, from 0) and ``place`` (0 to 1; by it, every
    stretch of the mix has about the target weights). Tokens are words. The last block of a
    source takes documents in the order of a hash while their tokens fit the
    budget; rows of one id are taken together. A null source is a source of its
    own; a source without tokens gives nothing unless ``keep_all``; a null id
    counts as the lowest; an empty table gives an empty mix. Input columns named epoch or place are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("epoch", "place")
    order = F.xxhash64(F.lit(seed), F.col("__epoch"), F.col(doc_id))
    slim = docs.select(F.col(source).cast("string").alias("__s"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_MIN)).alias("__id"), F.col(doc_id), word_count(text).alias("__n"))
    slim = runtime.cut(slim)
    rows = slim.groupBy("__s").agg(F.sum("__n").alias("n"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["__s"]: r["n"] for r in rows}
    given = plan(sizes, budget, target_entropy, max_epochs, keep_all)
    table = []
    for r in rows:
        n, s = r["n"], r["__s"]
        full, rest = divmod(given[s], n) if s in given else (int(keep_all), 0)
        table.append((s, full, rest, -(-r["docs"] // PER_BUCKET), (full + rest / n) if n else float(full)))
    schema = "__s string, __epoch long, __rest long, __buckets long, __total double"
    dims = F.broadcast(spark.createDataFrame(table, schema))  # a row for each source
    last = slim.join(dims.where("__rest > 0"), slim["__s"].eqNullSafe(dims["__s"])).drop(dims["__s"]).withColumn("__h", order)
    last = last.withColumn("__b", F.floor((F.shiftrightunsigned("__h", 1) / float(1 << 63)) * F.col("__buckets"))).select("__s", "__id", "__n", "__h", "__b", "__rest")
    sums = last.groupBy("__s", "__b", "__rest").agg(F.sum("__n").alias("__n"))
    w = Window.partitionBy("__s").orderBy("__b")
    sums = sums.withColumn("__before", F.sum("__n").over(w) - F.col("__n"))
    cut = sums.where("__before <= __rest and __before + __n > __rest").select(F.col("__s").alias("__t"), F.col("__b").alias("__c"), "__before")
    inner = last.join(F.broadcast(cut), F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__c")))  # a row for each source
    key = F.struct(F.shiftrightunsigned("__h", 1), F.col("__h"), F.col("__id"))
    run = F.sum("__n").over(Window.partitionBy("__s").orderBy(F.shiftrightunsigned("__h", 1), "__h", "__id"))
    marks = inner.withColumn("__run", run + F.col("__before")).where("__run <= __rest").groupBy("__s").agg(F.max(key).alias("__mark"))
    cuts = {r["__t"]: r["__c"] for r in cut.collect()}
    found = {r["__s"]: tuple(r["__mark"]) for r in marks.collect()}
    table = [(*row, cuts.get(row[0], -1 if not row[2] else row[3]), *found.get(row[0], (None, None, None))) for row in table]
    dims = F.broadcast(spark.createDataFrame(table, schema + ", __cut long, __m1 long, __m2 long, __m3 long"))
    x = docs.join(dims, F.col(source).cast("string").eqNullSafe(dims["__s"]))
    x = x.withColumn("__h", order).withColumn("__u", F.shiftrightunsigned("__h", 1))
    b = F.floor((F.col("__u") / float(1 << 63)) * F.col("__buckets"))
    mine = F.struct(F.col("__u"), F.col("__h"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_MIN)))
    mark = F.struct(F.col("__m1"), F.col("__m2"), F.col("__m3"))
    partly = (F.col("__rest") > 0) & ((b < F.col("__cut")) | ((b == F.col("__cut")) & F.col("__m1").isNotNull() & (mine <= mark)))
    copies = F.col("__epoch") + F.coalesce(partly, F.lit(False)).cast("long")
    x = x.withColumn("__copies", copies).where("__copies > 0")
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).withColumn("epoch", F.col("epoch").cast("long"))
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("epoch"), F.col(doc_id)), 1) / float(1 << 63)
    return x.withColumn("place", F.least((F.col("epoch") + spread) / F.col("__total"), F.lit(1.0))).select(*docs.columns, "epoch", "place")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs, target_entropy=0.98, max_epochs=4.0)
    return mixed.select("doc_id", "source", word_count("text").alias("n_tokens"), "epoch", "place")
