"""Document toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model gives each sentence evidence
from hashed features of its words (the word, its beginnings and its ending):
the softplus of its score, as far as it exceeds a leak. A noisy-or of the
sentences gives the document's probability, 1 - exp(-sum of evidence). Weights,
bias and leak are trained by that same rule from document labels alone, on a
bounded sample of labelled rows chosen by a hash of their id; every document is
scored whole.

Length alone makes no document toxic: ordinary sentences stay under the leak
and give no evidence at all, and neither does one without a weighted feature. A
model without weights scores all 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import textbytes as tb
from loomspark.llm.arrow import with_columns

SAMPLE = 4096  # most labelled rows that are fitted
BYTES = 32 << 20  # most bytes of features that are fitted; a row of over a 64th of it isn't learned from
BITS = 20
EPOCHS = 100
BIAS, LEAK = -6.0, 0.1  # where training starts
RIDGE = 3e-4  # chosen, as the start, by cross-validation among the rows that are learned from

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)  # letters and everything beyond ASCII
_WORD[[*range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def features(buf: np.ndarray, off: np.ndarray):
    """Hashed features, the sentence of each; then document, start and end of each sentence."""
    low = _LOWER[buf]
    end = _STOP[low].copy()
    end[off[1:][off[1:] > off[:-1]] - 1] = True
    e = np.flatnonzero(end) + 1
    s = np.concatenate([[0], e[:-1]]) if len(e) else e
    doc = np.searchsorted(off, s, side="right") - 1
    inside = _WORD[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    ws, we = edge[::2], edge[1::2]
    cut = off[1:-1]  # a word doesn't reach over the end of a document
    over = np.searchsorted(cut, we, side="left") > np.searchsorted(cut, ws, side="right") if len(cut) else np.zeros(len(ws), bool)
    if over.any():
        a, b = [], []
        for p, q in zip(ws[over].tolist(), we[over].tolist(), strict=True):
            mid = [int(c) for c in cut[np.searchsorted(cut, p, side="right") : np.searchsorted(cut, q, side="left")]]
            a += [p, *mid]
            b += [*mid, q]
        ws, we = np.concatenate([ws[~over], np.array(a, np.int64)]), np.concatenate([we[~over], np.array(b, np.int64)])
        order = np.argsort(ws, kind="stable")
        ws, we = ws[order], we[order]
        whole = we > ws
        ws, we = ws[whole], we[whole]
    sentence = np.searchsorted(e, ws, side="right")
    h, size, out, owner = tb.prefix(low), we - ws, [], []
    for salt, (a, b, use) in enumerate(
        [(ws, we, slice(None)), *((ws, ws + k, size > k) for k in (4, 5, 6)), (we - 4, we, size > 4)]
    ):
        out.append((tb.span_hash(h, a[use], b[use]) + np.uint64(salt) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(sentence[use])
    return np.concatenate(out), np.concatenate(owner), doc, s, e


def _evidence(z: np.ndarray, leak: float) -> np.ndarray:
    return np.maximum(np.logaddexp(0, z) - leak, 0)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak from (label, features, feature counts by sentence) of each document."""
    w = np.zeros(1 << BITS, np.float32)
    y = np.array([b[0] for b in bags], np.float64)
    if not len(y) or y.min() == y.max():
        return w, BIAS, LEAK
    seen = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for label, f, _ in bags:
        seen[label][np.unique(f)] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    chosen = np.flatnonzero((seen[0] + seen[1] >= 3) & (odds > 1))  # what speaks for toxicity
    index = np.full(1 << BITS, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    feature, owner, doc, n = [], [], [], 0
    for k, (_, f, counts) in enumerate(bags):
        i, own = index[f], np.repeat(np.arange(len(counts)), counts) + n
        feature.append(i[i >= 0])
        owner.append(own[i >= 0])
        doc.append(np.full(len(counts), k))
        n += len(counts)
    feature, owner, doc = map(np.concatenate, (feature, owner, doc))
    told = np.unique(owner)  # sentences with a weighted feature; the others give no evidence
    owner, doc, n = np.searchsorted(told, owner), doc[told], len(told)
    x, bias, leak = odds[chosen], BIAS, np.log(LEAK)
    m, v = np.zeros(len(x) + 2), np.zeros(len(x) + 2)
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for t in range(1, EPOCHS + 1):
        z = np.bincount(owner, x[feature], n) + bias
        given = _evidence(z, np.exp(leak))
        p = np.clip(1 - np.exp(-np.bincount(doc, given, len(y))), 1e-3, 1)
        slope = balance * np.where(y > 0, -(1 - p) / p, 1.0) / len(y)
        g_given = slope[doc] * (given > 0)
        g_z = g_given * np.exp(-np.logaddexp(0, -z))
        g = np.concatenate([np.bincount(feature, g_z[owner], len(x)) + RIDGE * x, [g_z.sum(), -g_given.sum() * np.exp(leak)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        x, bias, leak = x - move[:-2], bias - move[-2], leak - move[-1]
    w[chosen] = x
    return w, float(bias), float(np.exp(leak))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most_bytes: int = BYTES) -> tuple[np.ndarray, float, float]:
    """Fit on at most ``sample`` labelled documents that aren't held out and ``most_bytes`` of their features.

    Labels other than 0 and 1 are left out. Rows that repeat an id count one by
    one within the bounds; a document of over a 64th of ``most_bytes`` isn't
    learned from.
    """
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).select(doc_id, F.col(label).cast("int").alias("__y"))
    rows = rows.withColumn("__h", F.xxhash64(doc_id)).orderBy("__h", doc_id, "__y").limit(sample)

    def run(batch: pa.RecordBatch) -> list:
        f, owner, doc, s, _ = features(*tb.utf8(batch.column(text)))
        order = np.argsort(owner, kind="stable")
        f, counts = f[order], np.bincount(owner, minlength=len(s))
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return [[f[ends[a] : ends[b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], [counts[a:b].astype(np.int64).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]]

    fields = [T.StructField("__f", T.BinaryType()), T.StructField("__n", T.BinaryType())]
    picked = docs.select(doc_id, text).join(F.broadcast(rows), doc_id).select(text, "__h", "__y")  # at most ``sample`` rows
    size = F.octet_length("__f") + F.octet_length("__n")
    made = with_columns(picked, run, fields).select("__h", "__y", "__f", "__n", size.alias("__size")).where(F.col("__size") <= most_bytes // 64)
    made = made.orderBy("__h", "__y", "__size", F.xxhash64("__f")).limit(sample)
    first = Window.orderBy("__h", "__y", "__size", F.xxhash64("__f"))
    got = made.withColumn("__sum", F.sum("__size").over(first)).where(F.col("__sum") <= most_bytes).select("__y", "__f", "__n").collect()  # at most ``sample`` rows and ``most_bytes``
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    return fit([(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int64)) for r in got])


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, weights: tuple[np.ndarray, float, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``, the sentences of 0.5 or more.

    ``offending`` holds start, end (code units of the text's UTF-8) and score.
    Null and empty texts have no sentence and score 0; input columns with these
    names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> list:
        w, bias, leak = sent.value
        buf, off = tb.utf8(batch.column(text))
        f, owner, doc, s, e = features(buf, off)
        given = _evidence(np.bincount(owner, w[f], len(s)) + bias, leak)
        given[np.bincount(owner, w[f] != 0, len(s)) == 0] = 0
        total = 1 - np.exp(-np.bincount(doc, given, batch.num_rows))
        p = 1 - np.exp(-given)
        bad: list[list] = [[] for _ in range(batch.num_rows)]
        for k in np.flatnonzero(p >= 0.5).tolist():
            bad[doc[k]].append({"start": int(s[k] - off[doc[k]]), "end": int(e[k] - off[doc[k]]), "score": float(p[k])})
        return [pa.array(total), bad]

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    return with_columns(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
