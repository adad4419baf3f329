"""Grouping spelling variants by rolling-hash deletions.

Words are counted first. Each word then gives a key for itself and one for each
of its letters, the hash of the word without that letter, from prefix sums of a
polynomial over its code points. Keys are dealt out by their leading bits and
sorted within each bucket; equal keys are verified on the strings. Words that
share a deletion at one place differ by one replaced letter, and a word that is
another's deletion by one inserted one. A task holds one bucket of keys. Within
a key only each word's count of partners and its best one are made, not pairs:
as many words as there are letters can share a deletion at one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.llm import textbytes as tb
from loomspark.llm.arrow import pieces

EVERY = 31  # a run is varied where this divides its crc32
SHORTEST, LEAST = 7, 2
RATIO = 10  # a form occurs at least so many times as often as its variant
PER_BUCKET = 500_000  # keys in a bucket
LONG = 200  # bytes; longer words travel as two hashes

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


def crc_of_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the crc32 ``before`` it."""
    state, size = before ^ np.uint32(0xFFFFFFFF), e - s
    left = np.flatnonzero(size <= 64)
    j = 0
    while len(left):
        left = left[size[left] > j]
        x = state[left]
        state[left] = _CRC[(x ^ buf[s[left] + j]) & 0xFF] ^ (x >> np.uint32(8))
        j += 1
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > 64).tolist():
        out[k] = zlib.crc32(buf[s[k] : e[k]].tobytes(), int(before[k]))
    return out


def _varied(batch: pa.RecordBatch, every: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the words of a batch of (prefix, text)."""
    raw, off = tb.utf8(batch.column(1))
    low = _LOWER[raw]
    wide = low == 0xC3  # first byte of U+00C0 to U+00FF
    inside = _LETTER[low] | wide
    inside[1:] |= wide[:-1]
    s, e, doc = tb.spans(inside, off)
    heads = np.zeros(len(low) + 1, np.int64)
    np.cumsum(wide, out=heads[1:])
    n = e - s - (heads[e] - heads[s])
    use = n >= shortest
    s, e, doc, n = s[use], e[use], doc[use], n[use]
    prefixes = batch.column(0).to_pylist()
    known = np.array([p is not None for p in prefixes], bool)
    before = np.array([zlib.crc32(p.encode()) if p is not None else 0 for p in prefixes], np.uint32)
    h = crc_of_spans(low, s, e, before[doc])
    cut = np.flatnonzero((h % every == 0) & known[doc])
    idx, at = tb.ragged(s, e - s)
    out, keep = low[idx], np.ones(len(idx), bool)
    first = np.flatnonzero((low & 0xC0) != 0x80)  # of each code point
    gone = first[np.searchsorted(first, s[cut]) + h[cut].astype(np.int64) % n[cut]]
    where, two = at[cut] + gone - s[cut], low[gone] == 0xC3
    keep[where] = False
    keep[where[two] + 1] = False
    size = e - s
    size[cut] -= 1 + two
    n[cut] -= 1
    keep &= np.repeat(n >= shortest, np.diff(at))
    return out[keep], np.concatenate([[0], np.cumsum(size[n >= shortest])])


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters with at least ``least`` occurrences in all texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. A
    run whose crc32 of ``<doc_id>:<run>`` is divided by ``every`` has lost the
    letter at that crc32 modulo its length; runs of a null id lose none. A null
    text has no word.
    """

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                buf, at = _varied(b, every, shortest)
                _, one, n = np.unique(tb.span_hash(tb.prefix(buf), at[:-1], at[1:]), return_index=True, return_counts=True)
                idx, bounds = tb.ragged(at[:-1][one], np.diff(at)[one])
                yield pa.RecordBatch.from_arrays([tb.strings(buf[idx], bounds), pa.array(n)], ["word", "n"])

    counted = docs.select(F.concat(F.col(doc_id).cast("string"), F.lit(":")), F.col(text)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


_COLUMNS = [("key", np.uint64), ("n", np.int64), ("at", np.int32), ("wide", np.uint8), ("letter", np.uint32), ("canon", np.uint8), ("size", np.uint8)]


def _rank_keys(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Rows of keys of a batch of (word, n); ``chars`` are the strings one after the other.

    ``at`` and ``wide`` are the deleted letter's place and width in bytes (width
    0: the word itself), ``canon`` tells the last of equal neighbours, which
    stands for their one deletion. A long word is told by a zero byte and its
    hash; a second hash of what the deletion leaves follows, to be verified.
    """
    raw, off = tb.utf8(batch.column(0))
    first = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
    width = np.diff(first)
    code = raw[first[:-1]].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        code[more] = code[more] << np.uint32(8) | raw[first[more] + k]  # keeps the order of code points among equal widths, and wider ones are larger
    c = np.searchsorted(first, off)  # bounds of words in code points
    s, e = c[:-1], c[1:]
    size = e - s
    word = np.repeat(np.arange(len(size)), size + 1)
    i, _ = tb.ragged(s, size + 1)  # each letter of a word, then its end for the word itself
    self = i == e[word]
    j = np.where(self, 0, i)
    s, e = s[word], e[word]

    def without(values: np.ndarray) -> np.ndarray:
        h, down = tb.prefix(values), tb._power(len(values) + 2)[1]
        rest = np.where(self, 0, (h[e] - h[np.minimum(i + 1, len(values))]) * down[s + 1])
        return tb.mix((h[i] - h[s]) * down[s] + rest)

    last = np.where(self, True, (j + 1 >= e) | (code[np.minimum(j + 1, len(code) - 1)] != code[j])) if len(code) else self
    long = (off[1:] - off[:-1] > LONG)[word]
    n = np.array(batch.column(1), np.int64)
    r = {
        "key": without(code),
        "n": n[word],
        "at": (first[i] - off[word]).astype(np.int32),
        "wide": np.where(self, 0, width[j] if len(width) else 0).astype(np.uint8),
        "letter": np.where(self, 0, code[j] if len(code) else 0).astype(np.uint32),
        "canon": last.astype(np.uint8),
        "size": np.where(long, 17, (off[1:] - off[:-1])[word]).astype(np.uint8),
    }
    start = off[:-1][word]
    if long.any():
        whole = tb.span_hash(tb.prefix(raw), off[:-1], off[1:])
        other = without(tb.mix(code.astype(np.uint64)))
        extra = np.zeros((int(long.sum()), 17), np.uint8)
        extra[:, 1:9] = whole[word[long]][:, None].view(np.uint8).reshape(-1, 8)
        extra[:, 9:] = other[long][:, None].view(np.uint8).reshape(-1, 8)
        start = start.copy()
        start[long] = len(raw) + 17 * np.arange(len(extra))
        raw = np.concatenate([raw, extra.ravel()])
    r["start"], r["raw"] = start, raw
    return r


def _take(r: dict[str, np.ndarray], rows: np.ndarray) -> list[bytes]:
    idx, _ = tb.ragged(r["start"][rows], r["size"][rows].astype(np.int64))
    return [*(r[c][rows].tobytes() for c, _ in _COLUMNS), r["raw"][idx].tobytes()]


def _runs_of(change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, size, and the number of its run for each row, where ``change`` marks first rows."""
    first = np.flatnonzero(change)
    return first, np.diff(np.concatenate([first, [len(change)]])), np.cumsum(change) - 1


def _same(key: np.ndarray, bytes_of: list[tuple[np.ndarray, np.ndarray]], raw: np.ndarray, text_of) -> np.ndarray:
    """Numbers of groups of equal strings among rows sorted by ``key``; strings are the two spans of each row."""
    change = np.concatenate([[True], key[1:] != key[:-1]])
    first, _, run = _runs_of(change)
    (a, m), (b, k) = bytes_of
    lead = first[run]
    equal = m + k == (m + k)[lead]
    rows = np.flatnonzero(equal & (lead != np.arange(len(key))))

    def laid(x: np.ndarray) -> np.ndarray:
        start, size = np.stack([a[x], b[x]], 1).ravel(), np.stack([m[x], k[x]], 1).ravel()
        return raw[tb.ragged(start, size)[0]]

    if len(rows):
        size = (m + k)[rows]
        differ = laid(rows) != laid(lead[rows])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        equal[rows[size > 0]] &= np.add.reduceat(np.concatenate([differ, [False]]).astype(np.int64), at)[size > 0] == 0
    group = run.astype(np.int64)
    fresh = len(first)
    for bad in np.unique(run[~equal]).tolist():  # a collision of keys: told apart by strings
        seen: dict = {}
        for x in np.flatnonzero(run == bad).tolist():
            text = text_of(x)
            if text not in seen:
                seen[text] = bad if not seen else fresh
                fresh += bool(len(seen) > 1)
            group[x] = seen[text]
    return group


def _partners(table: pa.Table) -> pa.Table:
    """(word, near, best_n, best) by the keys of one bucket."""
    parts = {c: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in [*_COLUMNS, ("chars", np.uint8)]}
    start = np.concatenate([[0], np.cumsum(parts["size"].astype(np.int64))])[:-1]
    order = np.argsort(parts["key"], kind="stable")
    key = parts["key"][order]
    alone = np.ones(len(key), bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    order, key = order[~alone], key[~alone]
    raw = parts.pop("chars")
    n, at, wide, letter, canon, size = (parts[c][order].astype(np.int64) for c, _ in _COLUMNS[1:])
    start = start[order]
    long = (size > 0) & (raw[np.minimum(start, max(len(raw) - 1, 0))] == 0) if len(raw) else size < 0
    a, m = np.where(long, start + 9, start), np.where(long, 8, at)
    b, k = np.where(long, start, start + at + wide), np.where(long, 0, size - at - wide)
    shown = np.where(long, 9, size)

    def text_of(x: int) -> bytes:
        return raw[a[x] : a[x] + m[x]].tobytes() + raw[b[x] : b[x] + k[x]].tobytes()

    group = _same(key, [(a, m), (b, k)], raw, text_of) if len(key) else key.astype(np.int64)
    word, best, near = [], [], []
    # one letter replaced: the same deletion at the same place
    o = np.lexsort((letter, -n, at, group))
    o = o[wide[o] > 0]
    if len(o):
        g, p = group[o], at[o]
        change = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
        first, many, run = _runs_of(change)
        ok = many[run] > 1
        top = np.where(np.arange(len(o)) == first[run], np.minimum(first[run] + 1, len(o) - 1), first[run])
        word.append(o[ok])
        best.append(o[top[ok]])
        near.append(many[run][ok] - 1)
    # one letter inserted: a word that is another's deletion
    o = np.argsort(group * 2 + (wide > 0), kind="stable")
    if len(o):
        g = group[o]
        first, _, run = _runs_of(np.concatenate([[True], g[1:] != g[:-1]]))
        lead = o[first[run]]
        ok = (wide[lead] == 0) & (wide[o] > 0) & (canon[o] > 0)
        for x, y in ((o[ok], lead[ok]), (lead[ok], o[ok])):
            word.append(x)
            best.append(y)
            near.append(np.ones(len(x), np.int64))
    word, best, near = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, best, near))

    def binary(rows: np.ndarray) -> pa.Array:
        idx, bounds = tb.ragged(start[rows], shown[rows])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[idx]))]).cast(pa.binary())

    return pa.table({"word": binary(word), "near": pa.array(near), "best_n": pa.array(n[best]), "best": binary(best)})


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of each word of (word, n) with a word at one inserted, deleted or replaced code point.

    ``best`` is the near word of largest n, the first in code-point order among
    ties. Words must be distinct; a null or empty word is near to none.
    """
    spark = counted.sparkSession
    counted = counted.where("word <> ''")
    letters = counted.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    bits = max(runtime.partitions(spark), -(-letters // PER_BUCKET) * 2 - 1).bit_length()

    def emit(rows: list[tuple[dict, np.ndarray]]):
        out = []
        for r in rows:
            bucket = (r["key"] >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edge = np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, bool)
            for part in np.split(order, np.flatnonzero(edge)[1:]):
                if len(part):
                    out.append((int(bucket[part[0]]), *_take(r, part)))
        out.sort(key=lambda x: x[0])
        k = 0
        while k < len(out):  # one row a bucket
            end = k
            while end < len(out) and out[end][0] == out[k][0]:
                end += 1
            yield (out[k][0], *(b"".join(x[c] for x in out[k:end]) for c in range(1, len(out[k]))))
            k = end

    names = ["bucket", *(c for c, _ in _COLUMNS), "chars"]

    def run(batches):
        held, keys = [], 0
        for whole in batches:
            for b in pieces(whole):
                held.append(_rank_keys(b))
                keys += len(held[-1]["key"])
                if keys >= PER_BUCKET:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in emit(held)], schema=arrow)
                    held, keys = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in emit(held)], schema=arrow)

    arrow = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in names[1:])])
    dealt = counted.select("word", "n").mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))
    found = dealt.groupBy("bucket").applyInArrow(_partners, "word binary, near long, best_n long, best binary")
    long = counted.where(F.octet_length("word") > LONG)
    if not long.isEmpty():

        def tell(batches):
            for b in batches:
                raw, off = tb.utf8(b.column(0))
                h = tb.span_hash(tb.prefix(raw), off[:-1], off[1:])
                yield pa.RecordBatch.from_arrays([pa.array([b"\0" + x.tobytes() for x in h], pa.binary()), b.column(0).cast(pa.binary())], ["id", "whole"])

        ids = long.select("word").mapInArrow(tell, "id binary, whole binary")
        for c in ("word", "best"):
            found = found.join(ids.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("whole", c)).drop("whole")
    found = found.select(F.col("word").cast("string").alias("word"), "near", F.struct((-F.col("best_n")).alias("n"), F.col("best").cast("string").alias("w")).alias("b"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("b").alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form from each word of (word, form) on. Forms must not go round in a circle."""
    at = runtime.stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("__far"))
        new = runtime.stored(at.join(ahead, "root", "left").select("word", F.coalesce("__far", "root").alias("root"), F.col("__far").isNotNull().alias("__moved")))
        runtime.discard(at)
        moved = not new.where("__moved").isEmpty()
        at = new.drop("__moved")
        at._loomspark_path = new._loomspark_path
        if not moved:
            return at


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    The form is the near word of largest n if that is at least ``ratio`` (2 or
    more, so that forms end) times the word's; the root is where the forms lead.
    """
    counted = runtime.stored(counted)
    near = near_words(counted)
    x = counted.join(near, "word", "left")
    good = F.col("best_n") >= F.col("n") * ratio
    x = runtime.stored(x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    runtime.discard(counted)
    found = roots(x.where("form is not null"))
    return x.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(words(docs))


#: crc32 goes byte by byte over a table of its 256 steps; near words meet by deletion strings.
OP11_SQL = """WITH RECURSIVE bits(b, k, x) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT list(x ORDER BY b) AS step FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
long_runs AS (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || r)) AS x FROM long_runs),
hashed AS (SELECT r, n, xor(4294967295, list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * j + 1, 2))::BIGINT FOR j IN range(len(x) // 2)],
  lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) AS h FROM hexed, steps),
varied AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM varied WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
walk(word, root) AS (SELECT word, form FROM formed WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN formed f ON f.word = root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)"""
