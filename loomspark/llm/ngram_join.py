"""Jaccard self-join of documents on word shingles, and its components.

Texts with one shingle set form a class; only the smallest document of a class
is joined. Two sets of r and s shingles that meet the threshold differ in at
most H shingles, H by their sizes. For each band of sizes the universe of
shingles is hashed into segments, and each segment gets an allowance: 0 (equal)
or 1 (a one-deletion neighbourhood). The segments form parts of ``PART``.
Allowances add up to so much that two similar sets agree, within the
allowance, in ``subset`` segments of one part at least. The numbers of segments
and of neighbourhoods are chosen by cost: the keys a set sends, and those of
them that hold few shingles. Both depend on the band's sizes alone, so a
document sends as many keys whatever the corpus holds. No key stands for an
empty segment: a set that leaves too many segments empty is dealt into segments
anew under another seed, until it doesn't, and sends the keys of each.

Keys that no other document has are found first and never become rows. What is
left is verified exactly on the whole sets, in two rounds: every document
against the smallest one of each key it has; then, where the documents of a key
still lie in several components, pairs across these. Only documents with
``subset`` such keys in one part take part in that. The documents of keys that
more than ``FEW`` have aren't joined with themselves: they are compared where
they share a shingle that is rare among them, at places that leave enough of
both. Pairs that a parity sketch rules out aren't verified (a sketch differs in
at most as many bits as the sets do in shingles). Pairs within a component can't
change the result, so groups of copies aren't expanded.

Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark import runtime
from loomspark.llm import repeats
from loomspark.llm import textbytes as tb
from loomspark.llm.arrow import pieces, with_columns
from loomspark.llm.components import components

RATIO = 1.5  # of a band's sizes
PART = 24  # segments of a part
FEW = 2048  # documents of a key that are compared with each other, by sketches, within one join
OFTEN = 50_000  # most shingles that are told as very frequent
SIZE_STEP = 1.02  # ratio of set sizes that are looked up together
LIGHT = 8.0  # what a key of one or two shingles costs: other sets hold it by chance
SEEDS = 64
SKETCH = 8  # longs of parity bits
STAND_INS = 1 << 62  # null ids are numbered from here on; ids lie below
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def stand_in(key):
    """A number above all ids in place of a null id."""
    return key.bitwiseAND(F.lit(STAND_INS - 1)).bitwiseOR(F.lit(STAND_INS))


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their document, ordered by document and hash."""
    low = _LOWER[buf]
    start, end, doc = tb.words(low, off)
    w = tb.span_hash(tb.prefix(low), start, end)
    n = max(0, len(w) - k + 1)
    g = w[:n].copy()
    for t in range(1, k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + w[t : t + n]
    inside = doc[:n] == doc[k - 1 : k - 1 + n]
    g, d = tb.mix(g[inside]), doc[:n][inside]
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = [int(tb.mix(np.array([sum((int(x) * pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j, x in enumerate(w[first[i] : first[i] + count[i]])) + int(count[i]) & (1 << 64) - 1], np.uint64))[0]) for i in few.tolist()]
        g, d = np.concatenate([g, np.array(short, np.uint64)]), np.concatenate([d, few])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
    return g[new], d[new]


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least part / whole."""

    part: int
    whole: int

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of similar sets whose sizes add up to total."""
        return (self.whole - self.part) * total // (self.whole + self.part)


def band(n: int) -> int:
    b = int(math.log(n) / math.log(RATIO))
    return b + (math.ceil(RATIO ** (b + 1)) <= n) - (math.ceil(RATIO**b) > n)


def sizes(b: int) -> tuple[int, int]:
    """The smallest and the largest size of a band."""
    return math.ceil(RATIO**b), math.ceil(RATIO ** (b + 1)) - 1


@dataclass(frozen=True)
class Plan:
    """Segments of a band, how many of them have a neighbourhood, how much allowance may lie in empty ones, and the subset that agrees."""

    segments: int
    near: int
    slack: int
    subset: int


def allocate(t: Threshold, b: int) -> Plan | None:
    """The plan of the band; None if only equal sets are similar."""
    low, high = sizes(b)
    h = t.most_apart(2 * high)
    if high < low or h == 0:
        return None
    fewest = -(-low * t.part // t.whole)  # of a set of a smaller band that may be similar
    subset = 1 if h == 1 else 2 if h < 24 else 3
    best = None
    for near in range(0, h + 2 if h < PART // 2 else 1):
        least = max(1, near, h + 1 - near)
        for m in range(least, 4 * least + 9, max(1, least // 50)):
            # Parts that agree in one segment less than the subset, and may do so where it counts most.
            slack = m + near - h - 1 - (subset - 1) * -(-m // PART) * (2 if near else 1)
            if slack < 0:
                continue
            empty = math.exp(-fewest / m)
            lost = (m + near) * empty + 2 * near * (fewest / m) * empty * (m > 1)
            again = 0.5 * math.erfc((slack + 0.5 - lost) / math.sqrt(2 * lost))  # share of sets dealt anew
            fill = math.sqrt(low * high) / m
            keys = (m - near) + near * (1 + fill)
            light = LIGHT * sum(math.exp(-fill) * fill**x / math.factorial(x) for x in (1, 2)) * m / subset
            cost = (keys + light) / max(1e-9, 1 - again)
            if again < 0.75 and (best is None or cost < best[0]):
                best = (cost, Plan(m, near, slack, subset))
    if best is None:
        raise ValueError(f"{t.part} / {t.whole} is too low: similar sets needn't share segments")
    return best[1]


def plans_of(t: Threshold, biggest: int) -> dict[int, Plan]:
    return {b: p for b in range(band(max(1, biggest)) + 2) if (p := allocate(t, b))}


def keys_of(g: np.ndarray, d: np.ndarray, plans: dict[int, Plan], t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment keys, their document and their part. g, d: from shingles()."""
    at = tb.runs(d)
    size = np.diff(np.append(at, len(d)))
    doc = d[at]
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    bands = {}
    for n in np.unique(size).tolist():
        b, up = band(n), 1
        bands[n] = [b]
        while n * t.whole >= t.part * sizes(b + up)[0]:  # the band of a larger set that may be similar
            bands[n].append(b + up)
            up += 1
    for b in sorted({x for v in bands.values() for x in v} & set(plans)):
        mine = np.array([b in bands[n] for n in size.tolist()])
        x, ids, n = g[np.repeat(mine, size)], doc[mine], size[mine]
        for seed in range(SEEDS):
            if not len(ids):
                break
            keys, who, part, bad = _seeded(x, n, b, plans[b], seed)
            out.append((keys, ids[who], part))
            x, ids, n = x[np.repeat(bad, n)], ids[bad], n[bad]
        if len(ids):  # never met, but nothing may be lost: these sets all meet each other
            out.append((np.full(len(ids), tb.mix(np.array([b], np.uint64))[0]), ids, np.full(len(ids), b, np.uint64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _seeded(x: np.ndarray, size: np.ndarray, b: int, plan: Plan, seed: int):
    """Keys under one seed, the set and the part of each; and which sets leave too many segments empty."""
    m, near = plan.segments, plan.near
    who = np.repeat(np.arange(len(size)), size)
    place = x if seed == 0 else tb.mix(x ^ np.uint64(seed))
    segment = ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    cell = who * m + segment
    if seed == 0:  # shingles are sorted within a document, and so are their segments
        order = slice(None)
    else:
        order = np.argsort(cell, kind="stable")
    cell, v = cell[order], tb.mix(x[order] + np.uint64(1))
    first = tb.runs(cell)
    total = np.add.reduceat(v, first)
    filled = np.diff(np.append(first, len(cell)))
    salt = tb.mix((np.uint64(b << 32) + np.uint64(seed << 24) + np.arange(m, dtype=np.uint64)) * np.uint64(2) + np.uint64(1))
    c_seg, c_doc = cell[first] % m, cell[first] // m
    part = (np.uint64(b << 32) + np.uint64(seed << 24)) + (c_seg // PART).astype(np.uint64)
    # Allowance in segments left empty, or emptied by one deletion.
    lost = np.full(len(size), m + near)
    np.subtract.at(lost, c_doc, np.where(c_seg < near, 2, 1))
    np.add.at(lost, c_doc[(c_seg < near) & (filled == 1)], 2)
    spread = np.repeat(np.arange(len(first)), filled)
    drop = (c_seg[spread] < near) & (filled[spread] > 1)
    less = tb.mix((total[spread[drop]] - v[drop]) ^ salt[c_seg[spread[drop]]])
    keys = np.concatenate([tb.mix(total ^ salt[c_seg]), less])
    return keys, np.concatenate([c_doc, c_doc[spread[drop]]]), np.concatenate([part, part[spread[drop]]]), lost > plan.slack


def parity(g: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """Parity sketch of each document's set."""
    bit = (g & np.uint64(64 * SKETCH - 1)).astype(np.int64)
    odd = np.bincount(d * (64 * SKETCH) + bit, minlength=docs * 64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd.reshape(docs, -1), axis=1, bitorder="little").view(np.int64).reshape(docs, SKETCH)


def set_columns(docs: DataFrame, text: str, k: int) -> DataFrame:
    """``docs`` with ``n_shingles`` and the 128-bit digest (``__d1``, ``__d2``) of the shingle set."""

    def run(batch: pa.RecordBatch) -> list:
        g, d = shingles(*tb.utf8(batch.column(text)), k)
        n = np.bincount(d, minlength=batch.num_rows)
        digest = np.zeros((2, batch.num_rows), np.uint64)
        if len(g):
            at = tb.runs(d)
            for j, v in enumerate((tb.mix(g), tb.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
                digest[j, d[at]] = tb.mix(np.add.reduceat(v, at))
        return [n, *(pa.array(x.view(np.int64)) for x in digest)]

    return with_columns(docs, run, [T.StructField("n_shingles", T.LongType()), T.StructField("__d1", T.LongType()), T.StructField("__d2", T.LongType())])


_ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "part", "id", "n", *(f"s{j}" for j in range(SKETCH)))] + [T.StructField("text", T.StringType())])


def _verify(pairs: DataFrame, texts: DataFrame, t: Threshold, k: int) -> DataFrame:
    """The (a, b) pairs whose whole sets meet the threshold. Texts travel, as they take less room than sets."""
    x = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for whole in batches:
            for some in pieces(whole):
                sides = []
                for c in ("text_a", "text_b"):
                    g, d = shingles(*tb.utf8(some.column(c)), k)
                    sides.append((g, np.searchsorted(d, np.arange(some.num_rows + 1))))
                (p, x), (q, y) = sides
                keep = []
                for i in range(some.num_rows):
                    r, s = p[x[i] : x[i + 1]], q[y[i] : y[i + 1]]
                    both = len(np.intersect1d(r, s, assume_unique=True))
                    keep.append(t.whole * both >= t.part * (len(r) + len(s) - both))
                yield pa.RecordBatch.from_arrays([some.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return x.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _with_leads(rows: DataFrame, where: str) -> DataFrame:
    """(key, ids, leads) of the keys that lie in several components: their documents, and whether the key leads those that the same documents have."""
    same = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"same{k}") for k in range(2)]
    keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("ids"), *same)
    keys = runtime.cut(keys.where("lo != hi").where(where).drop("lo", "hi"))
    leads = keys.groupBy("same0", "same1", "ids").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("leads"))
    return keys.select("key", "ids").join(leads, "key", "left").select("key", "ids", F.col("leads").isNotNull().alias("leads"))


def _open(keys: DataFrame, comp: DataFrame, subset: dict[int, int]) -> DataFrame:
    """(part, id, c, least, list) of the documents' keys that lie in several components, where there are enough in a part.

    ``list`` has (key, documents of the key, whether it leads), at most the keys
    of PART segments; ``least`` of them are shared with any similar document of
    another component. Of keys that the same documents have, one leads.
    """
    placed = keys.join(comp, "id", "left").select("key", "part", "id", F.coalesce("component", "id").alias("c"))
    open_keys = _with_leads(placed, "ids > 2")  # of two documents, one is the smallest
    sizes = F.create_map(*(F.lit(x) for kv in (subset or {0: 1}).items() for x in kv))
    least = F.coalesce(F.try_element_at(sizes, F.shiftright("part", 32).cast("int")), F.lit(1))
    lists = placed.join(open_keys, "key").groupBy("part", "id", "c").agg(F.sort_array(F.collect_list(F.struct("key", "ids", "leads"))).alias("list"))
    return lists.withColumn("least", least).where(F.size("list") >= F.col("least"))


def _may_be_similar(t: Threshold):
    """Neither the sizes nor the parity sketches of p and q rule the pair out."""
    r, s = F.col("p.n"), F.col("q.n")
    bits = sum((F.bit_count(F.col(f"p.s{j}").bitwiseXOR(F.col(f"q.s{j}"))) for j in range(SKETCH)), F.lit(0))
    return (t.whole * F.least(r, s) >= t.part * F.greatest(r, s)) & (bits * (t.part + t.whole) <= (t.whole - t.part) * (r + s))


def _across(rest: DataFrame, sketches: DataFrame, texts: DataFrame, t: Threshold, k: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key of few documents, or else a rare shingle at a place that counts."""
    single = rest.select("id", "c", F.explode("list").alias("k")).select("id", "c", "k.*")
    few = single.where((F.col("ids") <= FEW) & F.col("leads")).select("key", "id", "c").join(sketches, "id")
    p, q = few.alias("p"), few.alias("q")
    on = (F.col("p.key") == F.col("q.key")) & (F.col("p.c") != F.col("q.c")) & (F.col("p.id") < F.col("q.id"))
    out = p.join(q, on & _may_be_similar(t)).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    many = runtime.cut(single.where(F.col("ids") > FEW).select("id", "c").distinct())
    if many.isEmpty():
        return out.distinct()
    return out.unionByName(_by_rare_shingles(many, sketches, texts, t, k)).distinct()


def _by_rare_shingles(docs: DataFrame, sketches: DataFrame, texts: DataFrame, t: Threshold, k: int) -> DataFrame:
    """Pairs (a, b) of (id, c) documents of different components that may be similar, by the places of what they share.

    Shingles are ordered by how many of these documents have them, rarest first.
    A set and a similar one of its size or more share a shingle that stands in
    the first n - least + 1 places of the smaller, where least is what two sets
    of its size must share, and so few places into the larger that what is left
    of both can still be enough. A passage that all have comes last in the
    order, so it makes no pair of documents whose own parts are too large.
    """

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                g, d = shingles(*tb.utf8(b.column(2)), k)
                ids, cs = (np.array(b.column(c)) for c in (0, 1))
                n = np.bincount(d, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[d]), pa.array(cs[d]), pa.array(n[d])], ["h", "id", "c", "n"])

    rows = docs.join(texts, "id").select("id", "c", "text").mapInArrow(run, "h long, id long, c long, n long")
    counts = runtime.stored(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    total = counts.agg(F.sum("df")).first()[0] or 0
    often = counts.where(F.col("df") > total / OFTEN)  # fewer than OFTEN, as all counts add up to the total
    rest = counts.where(F.col("df") <= total / OFTEN)
    met = rows.join(F.broadcast(often), "h").unionByName(rows.join(F.broadcast(often.select("h")), "h", "left_anti").join(rest, "h"))
    lists = met.groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("l"))  # of one set
    x = lists.select("id", "c", "n", (F.col("n") - F.size("l")).alias("alone"), F.posexplode("l").alias("at", "k"))
    x = x.select("id", "c", "n", F.col("k.h").alias("h"), (F.col("at") + F.col("alone")).alias("at"))  # shingles that no other set has come first
    p, w = t.part, t.whole
    up = lambda v, by: F.call_function("div", v + (by - 1), F.lit(by).cast("long"))
    least = lambda r, s: up((r + s) * p, p + w)  # noqa: E731  # shared shingles of similar sets
    step = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")
    n, at = F.col("n"), F.col("at")
    small = x.where(at <= n - least(n, n)).select("h", step(n).alias("step"), F.col("id").alias("a"), F.col("c").alias("ca"), n.alias("r"), at.alias("i"))
    lowest, highest = up(n * p, w), F.least(n, F.call_function("div", (n - at) * (p + w), F.lit(p).cast("long")) - n)  # sizes of smaller sets that this place may be enough for
    large = x.where((at <= n - lowest) & (highest >= lowest)).withColumn("step", F.explode(F.sequence(step(lowest), step(highest))))
    large = large.select("h", "step", F.col("id").alias("b"), F.col("c").alias("cb"), n.alias("s"), at.alias("j"))
    small, large = runtime.stored(small), runtime.stored(large)
    # where all documents of a shingle lie in one component there is nothing to compare
    here = small.select("h", "step", F.col("ca").alias("c")).unionByName(large.select("h", "step", F.col("cb").alias("c")))
    here = here.groupBy("h", "step").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("h", "step")
    r, s = F.col("r"), F.col("s")
    on = (F.col("ca") != F.col("cb")) & ((r < s) | ((r == s) & (F.col("a") < F.col("b")))) & (r * w >= s * p) & (F.col("i") <= r - least(r, s)) & (F.col("j") <= s - least(r, s))
    pairs = small.join(here, ["h", "step"]).join(large, ["h", "step"]).where(on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(sketches.alias("p"), F.col("a") == F.col("p.id")).join(sketches.alias("q"), F.col("b") == F.col("q.id")).where(_may_be_similar(t)).select("a", "b")
    pairs = runtime.stored(pairs)
    runtime.discard(counts, small, large)
    return pairs


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, part: int = 85, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document, linked at Jaccard part/whole or more.

    Words are runs other than space and U+0009-U+000D, with A-Z lower-cased; a
    text of fewer than k words is one shingle. Null and empty texts have no
    shingle and no link, and are their own component. ``component_id`` is the
    smallest id reachable by links. A row with a null id gets its component but
    never names one (a component of such rows alone is null); rows that share an
    id are one document whose links add up.
    """
    spark, t = docs.sparkSession, Threshold(part, whole)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim = runtime.stored(set_columns(docs, "text", k).withColumn("__key", F.xxhash64("doc_id", "text")).drop("text"))
    classes = slim.where("n_shingles > 0").groupBy("__d1", "__d2").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "__key"))["__key"].alias("__key"), F.first("n_shingles").alias("n"))
    classes = runtime.stored(classes.withColumn("id", F.coalesce("id", stand_in(F.col("__key")))))
    biggest = classes.agg(F.max("n")).first()[0] or 0
    plans = plans_of(t, biggest)
    blocks = repeats.block_count(docs, "text")
    buckets = max(2 * runtime.partitions(spark), blocks // 2)
    x = repeats.dealt(docs, "doc_id", "text", blocks)
    # A class is worked on where its smallest document lies.
    own = classes.select(F.pmod("__key", F.lit(blocks)).alias("to"), F.col("__key").alias("sender"), F.lit(None).cast("binary").alias("payload"), "id")

    def chosen(table, told):
        """Shingles of the block's class representatives, their ids and their texts."""
        ids = dict(zip(told["sender"].to_pylist(), told["id"].to_pylist(), strict=True))
        at, keys = [], []
        for i, key in enumerate(table["__key"].to_pylist()):
            if key in ids:
                at.append(i)
                keys.append(ids.pop(key))
        texts = table["text"].take(pa.array(at, pa.int64()))
        return *shingles(*tb.utf8(texts), k), np.array(keys, np.int64), texts

    def send(key, table, told):
        if not table.num_rows:
            return repeats.mail([])
        g, d, _, _ = chosen(table, told)
        return repeats.distinct_mail(table["__block"][0].as_py(), keys_of(g, d, plans, t)[0], buckets)

    def shared_here(table, told):
        mask = np.array(told["payload"].is_valid())
        g, d, ids, texts = chosen(table, told.filter(pa.array(~mask)))
        shared, _ = repeats.opened_values(told.filter(pa.array(mask)))
        v, who, part = keys_of(g, d, plans, t)
        v = repeats.codes(v, buckets)
        order = np.lexsort((who, v))
        v, who, part = v[order], who[order], part[order]
        if len(v):
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (who[1:] != who[:-1])])
            v, who, part = v[new], who[new], part[new]
            at = tb.runs(v)
            n = np.diff(np.append(at, len(v)))
            keep = np.repeat(n > 1, n) | repeats._in_sorted(v, shared)[0]
            v, who, part = v[keep], who[keep], part[keep]
        return g, d, ids, texts, v, who, part

    def rows(key, table, told):
        """The shared keys of each set, and once its text and sketch (with a null key)."""
        empty = pa.table([pa.array([], pa.string() if f.name == "text" else pa.int64()) for f in _ROW], _ROW.names)
        if not table.num_rows:
            return empty
        g, d, ids, texts, v, who, part = shared_here(table, told)
        if not len(v):
            return empty
        n = np.bincount(d, minlength=len(ids))
        none = pa.nulls(len(v), pa.int64())
        first = [pa.array(v.view(np.int64)), pa.array(part.view(np.int64)), pa.array(ids[who]), none, *[none] * SKETCH, pa.nulls(len(v), pa.string())]
        pick = np.unique(who)
        sk = parity(g, d, len(ids))[pick]
        none = pa.nulls(len(pick), pa.int64())
        second = [none, none, pa.array(ids[pick]), pa.array(n[pick].astype(np.int64)), *(pa.array(np.ascontiguousarray(sk[:, j])) for j in range(SKETCH)), texts.take(pa.array(pick)).cast(pa.string())]
        return pa.concat_tables([pa.table(first, _ROW.names), pa.table(second, _ROW.names)])

    grouped = x.groupBy("__block")
    sent = grouped.cogroup(own.groupBy("to")).applyInArrow(send, repeats.MAIL)
    told = repeats.shared_values(sent).withColumn("id", F.lit(None).cast("long")).unionByName(own)
    found = runtime.stored(grouped.cogroup(told.groupBy("to")).applyInArrow(rows, _ROW))
    keys, texts = found.where("key is not null").select("key", "part", "id"), found.where("text is not null").select("id", "text")
    sketches = found.where("text is not null").drop("key", "part", "text")

    hub = keys.groupBy("key").agg(F.min("id").alias("hub"))
    first = keys.join(hub, "key").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = first.join(sketches.alias("p"), F.col("a") == F.col("p.id")).join(sketches.alias("q"), F.col("b") == F.col("q.id"))
    first = runtime.stored(first.where(_may_be_similar(t)).select("a", "b"))
    links = runtime.stored(_verify(first, texts, t, k))
    comp = components(links)
    rest = runtime.stored(_open(keys, comp, {b: p.subset for b, p in plans.items()}))
    second = _across(rest, sketches, texts, t, k).join(first, ["a", "b"], "left_anti")
    more = runtime.stored(_verify(second, texts, t, k))
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    runtime.discard(found, first, links, rest, more)  # components() has cut its result from them
    named = classes.join(comp, "id", "left").select("__d1", "__d2", F.coalesce("component", "id").alias("c"))
    out = slim.join(named, ["__d1", "__d2"], "left").select("doc_id", "n_shingles", "c")
    # A row id can stand in several classes (rows that share an id): their classes are one.
    twice = slim.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same = out.join(twice, "doc_id").where("c is not null").groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    if not same.isEmpty():
        pairs = out.join(same.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))
        merged = components(pairs).select(F.col("id").alias("c"), F.col("component").alias("m"))
        out = out.join(merged, "c", "left").withColumn("c", F.coalesce("m", "c"))
    # Stand-ins lie above all ids, so only a component of null ids alone still has one.
    c = F.when(F.col("doc_id").isNotNull() | (F.col("c") < STAND_INS), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", c.alias("component_id"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), g AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle FROM w
), s AS (
  SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(n - 3, 1)
), c AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id WHERE 100 * common.n >= 85 * (x.size + y.size - common.n)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, r.c FROM r JOIN links ON r.id = links.a
), m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id
FROM documents d JOIN m ON d.doc_id = m.id LEFT JOIN c ON d.doc_id = c.doc_id
"""
