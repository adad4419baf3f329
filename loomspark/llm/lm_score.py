"""Scoring texts by a hashed maximum-entropy language model.

A word's probability is that of its class times that within its class. The most
frequent words fill classes of ``SLOTS`` words; all others fall into classes by
their ending, where a word has its smoothed share of the class's occurrences.
Class and word are softmaxes over the logarithm of their share plus the weights
of the word before, the one before that (a skip), and both together; features
are hashed to rows of two weight tables of a fixed size. Training goes once
over all training texts in ``ROUNDS`` parts. In each part every task descends
the gradient over its own rows from the common weights, and the changes of a
row are averaged by how often each task met it, in a tree of at most ``FAN``
tasks a step, so the driver gets one table whatever the corpus.

Counts of words are of the whole training corpus. Those of the most frequent
ones are broadcast; texts meet those of the others in a join on the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspark import runtime
from loomspark.llm import textbytes as tb
from loomspark.llm.arrow import pieces

CLASSES, SLOTS, ENDINGS = 16, 64, 16  # classes of frequent words, words in each; classes by ending
SHORT = CLASSES * SLOTS
HEAD = 1 << 17  # most words whose counts are broadcast
CLASS_BITS, WORD_BITS = 13, 14  # rows of the weight tables
BLOCK = 1024  # rows of a table that travel together
ROUNDS, BATCH, RATE = 2, 2048, 0.6
FAN = 32
FEATURES = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.uint64(0x5DEECE66D1234567)  # the key of a text's end
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_NONE = np.float32(-1e9)


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and ending class of each token, its end among them, and the n + 1 bounds of the texts."""
    raw, off = tb.utf8(column)
    low = _LOWER[raw]
    s, e, doc = tb.words(low, off)
    h = tb.prefix(low)
    n = np.bincount(doc, minlength=len(off) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    key = np.full(bounds[-1], _END, np.uint64)
    ending = np.zeros(bounds[-1], np.int64)
    at = np.arange(len(s)) + doc
    key[at] = tb.span_hash(h, s, e)
    ending[at] = (tb.span_hash(h, np.maximum(s, e - 2), e) >> np.uint64(60)).astype(np.int64)
    return key, ending, bounds


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, ending, c): occurrences of each token in all texts; words are told by a 64-bit hash."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                key, ending, _ = tokens(b.column(0))
                key, one, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ending[one].astype(np.int32)), pa.array(n)], ["key", "ending", "c"])

    return docs.select(text).mapInArrow(run, "key long, ending int, c long").groupBy("key", "ending").agg(F.sum("c").alias("c"))


class Lexicon:
    """What tasks know of words: counts of the most frequent ones, classes, and the shares of each."""

    def __init__(self, head: pa.Table, mass: dict[int, float], n: int, v: int, short: int = SHORT):
        key, c, ending = np.array(head["key"]).view(np.uint64), np.array(head["c"]), np.array(head["ending"])
        order = np.lexsort((key, -c))
        key, c, ending = key[order], c[order], ending[order]
        rank = np.argsort(key)
        self.keys, self.rank, self.c = key[rank], rank, c
        self.short = min(short, SHORT, len(c))
        shares = c[: self.short] + 0.5
        words = np.full(SHORT, _NONE, np.float32)
        words[: self.short] = np.log(shares)
        self.words = words.reshape(CLASSES, SLOTS)
        total = np.zeros(CLASSES + ENDINGS)
        np.add.at(total, np.arange(self.short) // SLOTS, shares)
        tail = np.array([mass.get(k, 0.0) for k in range(ENDINGS)])
        np.subtract.at(tail, ending[: self.short], shares)
        total[CLASSES:] = np.maximum(tail, 0) + 0.5  # an unseen word of the ending
        self.total = total
        self.classes = np.where(total > 0, np.log(np.maximum(total, 1e-30)), _NONE).astype(np.float32)
        self.n, self.v = n, v

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        """Place by falling count, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)


@dataclass
class Model:
    counts: DataFrame  # (key, ending, c) of all training tokens
    lexicon: Lexicon
    classes: np.ndarray
    words: np.ndarray


def _rows(lex: Lexicon, rank: np.ndarray, ending: np.ndarray, bounds: np.ndarray):
    """Class and slot of each token (slot -1 outside frequent words) and the hashes of its features."""
    short = (rank >= 0) & (rank < lex.short)
    cls = np.where(short, rank // SLOTS, CLASSES + ending)
    slot = np.where(short, rank % SLOTS, -1)
    ctx = np.where(short, rank, SHORT + ending).astype(np.uint64)
    first = bounds[:-1]
    one, two = np.empty_like(ctx), np.empty_like(ctx)
    start = np.uint64(SHORT + ENDINGS)
    one[1:], two[2:] = ctx[:-1], ctx[:-2]
    one[first] = two[first] = start
    second = first[np.diff(bounds) > 1] + 1
    two[second] = start
    f = np.stack([one, two, two * np.uint64(SHORT + ENDINGS + 1) + one], 1)
    return cls, slot, tb.mix((f + np.uint64(1)) * _SALT)


def _places(feature: np.ndarray, cls: np.ndarray | None) -> np.ndarray:
    """Rows of the features in the table of classes, or in that of the words of ``cls``."""
    if cls is None:
        return (feature >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    return (tb.mix(feature + (cls.astype(np.uint64) * _SALT[0])[:, None]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _softmax(base: np.ndarray, table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural logarithm of the target's probability, probabilities)."""
    z = base + table[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += table[rows[:, k]]
    z -= z.max(1, keepdims=True)
    hit = z[np.arange(len(z)), target].astype(np.float64)
    p = np.exp(z, out=z)
    total = p.sum(1, keepdims=True)
    hit -= np.log(total[:, 0].astype(np.float64))
    p /= total
    return hit, p


def log_probabilities(lex: Lexicon, classes: np.ndarray, words: np.ndarray, cls, slot, feature) -> np.ndarray:
    """Natural logarithm of each token's class and, for a frequent word, of the word within it."""
    out = np.zeros(len(cls))
    for a in range(0, len(cls), BATCH):
        b = slice(a, a + BATCH)
        got, _ = _softmax(lex.classes, classes, _places(feature[b], None), cls[b])
        m = np.flatnonzero(slot[b] >= 0)
        if len(m):
            c = cls[b][m]
            got[m] += _softmax(lex.words[c], words, _places(feature[b][m], c), slot[b][m])[0]
        out[b] = got
    return out


def _descend(table: np.ndarray, power: np.ndarray, met: np.ndarray, rows: np.ndarray, p: np.ndarray, target: np.ndarray) -> None:
    """One step for the rows of a batch, with a rate that falls with each row's squared gradients."""
    p[np.arange(len(p)), target] -= 1
    flat = rows.T.ravel()
    order = np.argsort(flat, kind="stable")
    sorted_rows = flat[order]
    first = tb.runs(sorted_rows)
    touched, n = sorted_rows[first], np.diff(np.append(first, len(order)))
    g = np.add.reduceat(p[order % len(p)], first, axis=0) / np.sqrt(n)[:, None]
    power[touched] += (g * g).mean(1)
    met[touched] += n
    table[touched] -= (RATE / rows.shape[1] * 2) * g / np.sqrt(power[touched] + 1e-2)[:, None]


def _learn(lex: Lexicon, classes: np.ndarray, words: np.ndarray, columns):
    """Changes of both tables and how often each row was met, after one pass over text columns."""
    now = [classes.copy(), words.copy()]
    power = [np.zeros(len(t), np.float32) for t in now]
    met = [np.zeros(len(t), np.float32) for t in now]
    for column in columns:
        key, ending, bounds = tokens(column)
        cls, slot, feature = _rows(lex, lex.rank_of(key), ending, bounds)
        for a in range(0, len(cls), BATCH):
            b = slice(a, a + BATCH)
            rows = _places(feature[b], None)
            _descend(now[0], power[0], met[0], rows, _softmax(lex.classes, now[0], rows, cls[b])[1], cls[b])
            m = np.flatnonzero(slot[b] >= 0)
            if len(m):
                c, target = cls[b][m], slot[b][m]
                rows = _places(feature[b][m], c)
                _descend(now[1], power[1], met[1], rows, _softmax(lex.words[c], now[1], rows, target)[1], target)
    return [now[0] - classes, now[1] - words], met


_CHANGES = "part int, worker int, delta binary, met binary"


def _averaged(table: pa.Table) -> pa.Table:
    """One row of the rows of one block: changes averaged by how often they were met."""
    table = table.sort_by("worker")
    met = [np.frombuffer(x, np.float32) for x in table["met"].to_pylist()]
    total = np.sum(met, 0, np.float64)
    delta = 0.0
    for x, m in zip(table["delta"].to_pylist(), met, strict=True):
        delta = delta + np.frombuffer(x, np.float16).reshape(len(m), -1).astype(np.float64) * m[:, None]
    delta = delta / np.maximum(total, 1)[:, None]
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "worker": pa.array([table["worker"][0].as_py() // FAN], pa.int32()), "delta": pa.array([delta.astype(np.float16).tobytes()]), "met": pa.array([total.astype(np.float32).tobytes()])})


def _round(rows: DataFrame, lexicon, classes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables after one pass over the one text column of ``rows``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((classes, words))  # two tables of a fixed size
    parts = [(1 << CLASS_BITS) // BLOCK, (1 << WORD_BITS) // BLOCK]

    def run(batches):
        delta, met = _learn(lexicon.value, *sent.value, (b.column(0) for whole in batches for b in pieces(whole)))
        worker, out = TaskContext.get().partitionId(), []
        for t in (0, 1):
            for k in range(parts[t]):
                b = slice(k * BLOCK, (k + 1) * BLOCK)
                if met[t][b].any():
                    out.append({"part": k + t * parts[0], "worker": worker, "delta": delta[t][b].astype(np.float16).tobytes(), "met": met[t][b].tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    schema = T.StructType.fromDDL(_CHANGES)
    workers = rows.rdd.getNumPartitions()
    changes = rows.mapInArrow(run, _CHANGES)
    while True:
        changes = changes.groupBy("part", (F.col("worker") / FAN).cast("int")).applyInArrow(_averaged, _CHANGES)
        workers = -(-workers // FAN)
        if workers <= 1:
            break
    out = [classes.copy(), words.copy()]
    for r in changes.collect():  # a row for each block of the tables
        t = int(r.part >= parts[0])
        k = r.part - t * parts[0]
        out[t][k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(r.delta, np.float16).reshape(BLOCK, -1)
    sent.destroy()
    return out[0], out[1]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, short: int = SHORT, most_listed: int = HEAD) -> Model:
    """A model of all rows that aren't held out. Null texts count as empty ones, with an end; without rows every word is unseen.

    ``short`` words at most are in classes of frequent words, and the counts of
    ``most_listed`` at most are broadcast.
    """
    spark = docs.sparkSession
    seen = docs.where(~held_out(doc_id)).select(text)
    counts = runtime.stored(token_counts(seen, text))
    sums = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row for each class
    size = F.floor(F.log2("c") * 16).cast("int")
    held, limit = 0, None
    for r in sorted(counts.groupBy(size.alias("s")).agg(F.count("*").alias("m")).collect(), reverse=True):  # at most 1,024 sizes
        if held + r.m > most_listed:
            break
        held, limit = held + r.m, r.s
    head = counts.where(size >= limit) if limit is not None else counts.where("false")
    lex = Lexicon(head.toArrow(), {r.ending: r.c + 0.5 * r.v for r in sums}, sum(r.c for r in sums), sum(r.v for r in sums), short)  # at most most_listed rows
    lexicon = spark.sparkContext.broadcast(lex)
    classes, words = np.zeros((1 << CLASS_BITS, CLASSES + ENDINGS), np.float32), np.zeros((1 << WORD_BITS, SLOTS), np.float32)
    for k in range(rounds):
        part = seen.where(F.pmod(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(rounds)) == k)
        classes, words = _round(part, lexicon, classes, words)
    return Model(counts, lex, classes, words)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score.

    ``score`` is the model's log10 probability of the text with its end,
    ``base_score`` that of its words' smoothed shares alone. A null text is
    empty: its end is its one token. Input columns with these names are replaced.
    """
    spark = docs.sparkSession
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (*new, text)]
    sent = spark.sparkContext.broadcast((model.lexicon, model.classes, model.words))  # of bounded size
    rare = T.StructType.fromDDL("__rare array<struct<key: long, n: int>>")["__rare"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double, __row long"), rare])
    arrow = to_arrow_schema(schema)

    def run(batches):
        lex, classes, words = sent.value
        place = TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in pieces(whole):
                key, ending, bounds = tokens(b.column(text))
                doc = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                rank = lex.rank_of(key)
                cls, slot, feature = _rows(lex, rank, ending, bounds)
                log = log_probabilities(lex, classes, words, cls, slot, feature) / np.log(10)
                listed = rank >= 0
                own = np.where(listed, np.log10(lex.c[np.maximum(rank, 0)] + 0.5) if len(lex.c) else 0.0, 0.0)
                log += np.where(slot < 0, own - np.log10(lex.total[cls]), 0.0)
                n = len(bounds) - 1
                order = np.lexsort((key[~listed], doc[~listed]))
                k, d = key[~listed][order], doc[~listed][order]
                first = np.union1d(tb.runs(k), tb.runs(d))
                many = np.diff(np.append(first, len(k)))
                pairs = pa.StructArray.from_arrays([pa.array(k[first].view(np.int64)), pa.array(many.astype(np.int32))], ["key", "n"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(d[first], minlength=n))]).astype(np.int32)
                columns = [pa.array(np.diff(bounds)), pa.array(np.bincount(doc, listed, n).astype(np.int64)), pa.array(np.bincount(doc, own, n)), pa.array(np.bincount(doc, log, n)), pa.array(np.arange(n) + place), pa.ListArray.from_arrays(pa.array(ends), pairs)]
                place += n
                columns = [b.column(c) for c in keep] + [c.cast(f.type) for c, f in zip(columns, list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(arrow, columns, strict=True)]))

    rows = runtime.stored(docs.select(*keep, text).mapInArrow(run, schema))
    met = rows.select("__row", F.explode("__rare").alias("r")).select("__row", F.col("r.key").alias("key"), F.col("r.n").alias("__n"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = met.join(model.counts.select("key", "c"), "key", "left").groupBy("__row").agg(F.sum(log * F.col("__n")).alias("__log"), F.sum(F.when(F.col("c").isNotNull(), F.col("__n")).otherwise(0)).alias("__known"))
    x = rows.drop("__rare").join(sums, "__row", "left")
    more, lex = F.coalesce("__log", F.lit(0.0)), model.lexicon
    whole = F.log10(F.lit(lex.n + 0.5 * (lex.v + 1)))
    return x.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op13_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
