"""Document fingerprints by Order MinHash (DataFrame functions only).

The k-mers of a text are its runs of ``K`` words, numbered by their occurrence
so that repeats count. Each of the ``SKETCHES`` sketches puts all numbered
k-mers of the text into an order of its own, takes the ``TUPLE`` smallest, puts
these back into text order and hashes the tuple, so a sketch changes when the
order of the text does.

An order is a hash (``HASHES`` independent ones) read from one of ``TURNS``
evenly spaced starting points on, and around from the largest value to the
smallest. Each such order is a uniformly random one, and a hash is sorted once
for all its starting points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
TUPLE = 2
HASHES = 4
TURNS = 16
SKETCHES = HASHES * TURNS
STARTS = [(t << 60) - (1 << 63) for t in range(TURNS)]  # of longs, from the smallest on


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _kmers(w: Column) -> Column:
    """Hashes of the k-mers of an array of words, in text order; all words are one if they are fewer than K."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(K))))
    return F.when(F.size(w) >= K, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def _numbered(g: Column) -> Column:
    """The k-mers, in text order, with the number of their occurrence mixed in."""

    def by_run(s: Column) -> Column:
        """s: (k-mer, position), sorted, so that repeats are neighbours."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["x"] != F.get(s, i - 1)["x"]))

        def run(st: Column, at: Column, r: Column) -> Column:
            n = F.coalesce(F.get(st, r + 1), F.size(s)) - at
            return F.transform(F.slice(s, at + 1, n), lambda e, o: F.struct(e["at"].alias("at"), F.xxhash64(e["x"], o).alias("x")))

        runs = _let(starts, lambda st: F.flatten(F.transform(st, lambda at, r: run(st, at, r))))
        return F.transform(F.sort_array(runs), lambda e: e["x"])

    once = F.transform(g, lambda x: F.xxhash64(x, F.lit(0)))
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(g)) == F.size(g), once).otherwise(_let(pairs, by_run))


def _under(g: Column, h: int) -> Column:
    """The numbered k-mers' values under one of the hashes."""
    return F.transform(g, lambda x: F.xxhash64(x, F.lit(h)))


def _tuples(v: Column, s: Column, firsts: Column) -> Column:
    """Hashes of each order's tuple; v are the values in text order, s sorted, firsts how many lie before each start."""
    n = F.size(s)
    taken = F.transform(firsts, lambda at: F.transform(F.sequence(F.lit(0), F.least(F.lit(TUPLE), n) - 1), lambda k: F.get(s, F.pmod(at + k, n).cast("int"))))

    def hashed(t: Column, placed: Column) -> Column:
        return F.xxhash64(F.array_sort(t, lambda a, b: (F.array_position(placed, a) - F.array_position(placed, b)).cast("int")))

    # An intersection keeps the order of its first array: all taken values in text order.
    tuples = _let(taken, lambda ts: _let(F.array_intersect(v, F.flatten(ts)), lambda placed: F.transform(ts, lambda t: hashed(t, placed))))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(tuples)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """``docs`` with ``out``, the Order MinHash of the text: ``SKETCHES`` longs.

    A text that is null or without words has an empty sketch; one of fewer than
    ``K`` words has one k-mer. A column named as ``out`` is replaced.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    df = docs.withColumn(out, words).withColumn(out, _kmers(F.col(out))).withColumn(out, _numbered(F.col(out)))
    parts = []
    for h in range(HASHES):
        v, s, f = (f"__{out}_{x}{h}" for x in "vsf")
        df = df.withColumn(v, _under(F.col(out), h))
        df = df.withColumn(s, F.sort_array(v)).withColumn(f, F.sort_array(F.concat(s, F.array(*map(F.lit, STARTS)))))
        df = df.withColumn(f, F.array(*(F.array_position(f, F.lit(x)) - 1 - t for t, x in enumerate(STARTS))))
        df = df.withColumn(v, _tuples(F.col(v), F.col(s), F.col(f))).drop(s, f)
        parts.append(v)
    return df.withColumn(out, F.concat(*parts)).drop(*parts)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches; 1 if both fingerprints are empty, 0 if one is."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(SKETCHES)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal)


def as_text(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def _next_lower(keys: DataFrame, few: int = 10_000) -> DataFrame:
    """(key, next): the next lower key of each distinct key, null for the lowest.

    Keys are ordered within ranges of 1,024; only the ranges' ends are ordered
    among each other, in the same way, until few enough ranges remain.
    """
    keys = keys.distinct()
    ranged = keys.withColumn("high", F.shiftright("key", 10))
    w = Window.partitionBy("high").orderBy(F.desc("key"))
    if keys.count() <= few:
        return keys.withColumn("next", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("key"))))
    inner = ranged.withColumn("next", F.lead("key").over(w))
    tops = ranged.groupBy("high").agg(F.max("key").alias("top"))
    after = _next_lower(tops.select(F.col("high").alias("key")), few).alias("a")
    ends = after.join(tops.alias("t"), F.col("a.next") == F.col("t.high")).select(F.col("a.key").alias("high"), "top")
    return inner.join(ends, "high", "left").select("key", F.coalesce("next", "top").alias("next"))


def with_next(docs: DataFrame, doc_id: str, carried: list[str], made=lambda df: df, also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``next_<column>``: the columns of the next document by descending id.

    ``made`` adds the costly columns ``also``, which are carried too; it works on
    each row once, and once more on a range's first row.

    The last document's next is the first. A null id counts as the lowest;
    rows of one id are ordered by a hash of the carried columns. Documents are
    ordered within ranges of 1,024 ids; only a range's last document looks
    beyond it.
    """
    keyed = docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn("__range", F.shiftright("__id", 10))
    follow = _next_lower(keyed.select(F.col("__range").alias("key")))
    top = follow.agg(F.max("key").alias("top"))
    follow = follow.crossJoin(F.broadcast(top)).select("key", F.coalesce("next", "top").alias("next"))  # one row
    w = Window.partitionBy("__range").orderBy(F.desc("__id"), F.xxhash64(*carried))
    row = F.struct(*carried, *also)
    placed = made(keyed).withColumn("__next", F.lead(row).over(w))
    heads = made(keyed.withColumn("__nth", F.row_number().over(w)).where("__nth = 1")).select(F.col("__range").alias("next"), row.alias("__head"))
    inside = placed.where("__next is not null")
    ends = placed.where("__next is null").drop("__next").join(follow.withColumnRenamed("key", "__range"), "__range").join(heads, "next").withColumnRenamed("__head", "__next")
    kept = [*docs.columns, *also, *(F.col(f"__next.{c}").alias(f"next_{c}") for c in (*carried, *also))]
    return inside.select(*kept).unionByName(ends.select(*kept))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, "doc_id", ["text"], fingerprint, ("sketch",))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    both = fingerprint(both.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
