"""Passages that repeat across documents: routing shared by both removers.

A *window* is ``width`` consecutive units (words or bytes) of one document.
Its *anchor* is the smallest hash among the ``gram``-unit substrings it holds,
so equal windows have equal anchors. The work goes in five shuffles, each by a
hash key, and the text itself is shuffled once:

1. documents are dealt into blocks of about ``BLOCK`` bytes by a hash;
2. every block sends each of its distinct anchors once to the anchor's bucket,
   which tells the blocks whose anchors another block has too;
3. blocks cut the windows with a repeated anchor into segments (consecutive
   windows of one anchor) and send each distinct segment once, with the
   smallest document that holds it, to a bucket: the anchor's, or for an anchor
   that more than ``HOT`` blocks hold, one of the anchor and a group of blocks;
4. an exact engine in each bucket compares the segments themselves and reports
   the windows that also start in a smaller document. What is left of the
   segments of common anchors then meets the other groups' in the anchor's own
   bucket, or, where more than ``VERY_HOT`` blocks hold the anchor, window by
   window in buckets by the window's content. So a passage in all documents
   reaches a bucket from about the square root of the number of blocks, and
   none gathers all surroundings of such a passage;
5. the blocks cut out what the engine reported.

Hashes only route: two windows count as equal only if an engine finds their
content equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark import runtime
from loomspark.llm import textbytes as tb

BLOCK = 2_000_000
HOT, VERY_HOT = 16, 1024
_FINAL, _BY_CONTENT = -1, -2  # where a segment goes after its first bucket; else a bucket
_NEVER = np.iinfo(np.int64).max  # stands for a null id: smaller than no other

#: engine(contents, smallest document of each) -> for each window of each
#: content in order, the smallest document in which that window starts.
Engine = Callable[[list[bytes], np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Units:
    """words: split on ASCII white space; else bytes."""

    words: bool
    width: int
    gram: int
    block: int = BLOCK
    hot: int = HOT
    very_hot: int = VERY_HOT

    def cut(self, buf: np.ndarray, off: np.ndarray):
        """Start, end and document of each unit; then first unit and anchor of each window."""
        h = tb.prefix(buf)
        if self.words:
            start, end, doc = tb.words(buf, off)
            w = tb.span_hash(h, start, end)
            n = max(0, len(w) - self.gram + 1)
            g = w[:n].copy()
            for t in range(1, self.gram):
                g = g * np.uint64(0x9E3779B97F4A7C15) + w[t : t + n]
            g = tb.mix(g)
        else:
            start = np.arange(len(buf), dtype=np.int32)
            end, doc = start + np.int32(1), np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
            g = tb.gram_hash(h, self.gram)
        del h
        a = tb.slide_min(g, self.width - self.gram + 1)
        del g
        first = np.flatnonzero(doc[: len(a)] == doc[self.width - 1 : self.width - 1 + len(a)]).astype(np.int32)
        return start, end, doc, first, a[first]


def block_count(docs: DataFrame, text: str, block: int = BLOCK) -> int:
    """Blocks for the whole input: by its bytes, and some for each shuffle partition."""
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * runtime.partitions(docs.sparkSession), -(-total // block))


def dealt(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """The documents with ``__key`` (of id and text) and ``__block``, dealt out by block."""
    p = runtime.partitions(docs.sparkSession)
    keyed = docs.withColumn("__key", F.xxhash64(F.col(doc_id).cast("long"), text))
    return keyed.withColumn("__block", F.pmod("__key", F.lit(blocks))).repartition(p, "__block")


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray):
    """(key, slice) of each run of equal neighbours."""
    at = tb.runs(keys)
    return zip(keys[at].tolist(), map(slice, at.tolist(), [*at[1:].tolist(), len(keys)]), strict=False)


MAIL = T.StructType([T.StructField("to", T.LongType()), T.StructField("sender", T.LongType()), T.StructField("payload", T.BinaryType())])


def mail(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, sender, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"to": pa.array(to, pa.int64()), "sender": pa.array(sender, pa.int64()), "payload": pa.array(payload, pa.binary())})


def codes(values: np.ndarray, buckets: int) -> np.ndarray:
    """What blocks and buckets call a hash: its bucket above its lower 32 bits.

    A bucket holds a bounded number of values, so few of its values are ever taken for
    one another, however many buckets there are; and that only costs a comparison.
    """
    return bucket_of(values, buckets).astype(np.uint64) << np.uint64(32) | values & np.uint64(0xFFFFFFFF)


def distinct_mail(block: int, values: np.ndarray, buckets: int) -> pa.Table:
    """Mail that sends a block's distinct values to their buckets."""
    u = np.unique(codes(values, buckets))
    return mail([(to, block, u[s].astype(np.uint32).tobytes()) for to, s in slices((u >> np.uint64(32)).astype(np.int64))])


def shared_values(sent: DataFrame, hot: int = HOT, very_hot: int = VERY_HOT) -> DataFrame:
    """Mail to each block: its values that other blocks sent too, then 1 byte each: cold, hot, very hot (0 to 2)."""

    def compare(key, table):
        blobs = table["payload"].to_pylist()
        v = np.concatenate([np.frombuffer(b, np.uint32) for b in blobs])
        who = np.repeat(np.array(table["sender"]), [len(b) // 4 for b in blobs])
        order = np.argsort(v, kind="stable")
        v, who = v[order], who[order]
        n = np.diff(np.append(tb.runs(v), len(v)))
        n = np.repeat(n, n)
        v, who, n = v[n > 1], who[n > 1], n[n > 1]
        order = np.argsort(who, kind="stable")
        v, who, n = v[order], who[order], n[order]
        grade = (n > hot).astype(np.uint8) + (n > very_hot)
        return mail([(to, key[0].as_py(), v[s].tobytes() + grade[s].astype(np.uint8).tobytes()) for to, s in slices(who)])

    return sent.groupBy("to").applyInArrow(compare, MAIL)


def opened_values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and grades from the mail of shared_values."""
    v, grade = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for bucket, b in zip(table["sender"].to_pylist(), table["payload"].to_pylist(), strict=True):
        n = len(b) // 5
        v.append(np.uint64(bucket << 32) | np.frombuffer(b, np.uint32, n).astype(np.uint64))
        grade.append(np.frombuffer(b, np.uint8, n, 4 * n))
    v, grade = np.concatenate(v), np.concatenate(grade)
    order = np.argsort(v)
    return v[order], grade[order]


def _in_sorted(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(there, x), max(0, len(there) - 1))
    return (there[at] == x if len(there) else np.zeros(len(x), bool)), at


def _anchor_runs(u: Units, buf, off):
    """Start and end of each unit, first unit of each window; then anchor, first and last + 1 window and document of each run of windows.

    Anchors are minima and so small numbers; their bits are spread anew, so that buckets are even.
    """
    start, end, doc, first, anchor = u.cut(buf, off)
    d = doc[first]
    at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (d[1:] != d[:-1])])) if len(d) else np.zeros(0, np.int64)
    return start, end, first, tb.mix(anchor[at]), at, np.append(at[1:], len(d)), d[at]


def _pack(rows: list[tuple[int, int, int, int, int, bytes]]) -> bytes:
    """(block, row, document, unit, next bucket, content) rows as one blob."""
    *head, content = zip(*rows, strict=True)
    parts = [np.array([len(rows)], np.int64), *(np.array(x, np.int64) for x in head), np.array(list(map(len, content)), np.int64)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*(p.tobytes() for p in parts), *content]))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    *head, size = np.frombuffer(raw, np.int64, 6 * n, 8).reshape(6, n)
    ends = (np.cumsum(size) + 8 + 48 * n).tolist()
    return *head, [raw[e - k : e] for e, k in zip(ends, size.tolist(), strict=True)]


def _spans(row, start, end) -> bytes:
    """A blob of covered unit ranges of a block's rows."""
    return np.array([row, start, end], np.int32).tobytes()


def _ordered(docs: pa.Table, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """The block's ids, null as _NEVER, and its rows' order, by id and then text: the same whenever the block is dealt out."""
    ids = np.array(docs[doc_id].cast(pa.int64()).fill_null(_NEVER))
    return ids, np.lexsort((np.array(docs["__key"]), ids))


def _segments(u: Units, block: int, docs: pa.Table, told: pa.Table, doc_id: str, text: str, blocks: int, buckets: int) -> pa.Table:
    ids, order = _ordered(docs, doc_id)
    ids = ids[order]
    buf, off = tb.utf8(docs[text].take(pa.array(order)))
    start, end, first, a, lo, hi, d = _anchor_runs(u, buf, off)
    if not len(lo):
        return mail([])
    shared, graded = opened_values(told)
    keep, at = _in_sorted(codes(a, buckets), shared)
    grade = np.where(keep, graded[at], 0) if len(shared) else np.zeros(len(a), np.uint8)
    by = np.argsort(a, kind="stable")  # anchors of two documents of this block
    g = tb.runs(a[by])
    g_end = np.append(g[1:], len(by))
    keep[by] |= np.repeat(ids[d[by[g]]] != ids[d[by[g_end - 1]]], g_end - g)
    raw, unit0 = buf.tobytes(), np.searchsorted(start, off[:-1])
    seen: dict[bytes, int] = {}
    out: dict[int, list] = {}
    direct: list[tuple[int, int, int]] = []
    pick = np.flatnonzero(keep)
    own = bucket_of(a[pick], buckets)
    group = tb.mix(np.array([block % math.isqrt(blocks) + 1], np.uint64))
    salted = bucket_of(tb.mix(a[pick] ^ group), buckets)
    rows = zip(pick.tolist(), grade[pick].tolist(), own.tolist(), salted.tolist(), strict=True)
    for i, common, to, first_to in rows:
        p, q, row = int(first[lo[i]]), int(first[hi[i] - 1]), int(d[i])
        me = int(ids[row])
        content = raw[start[p] : end[q + u.width - 1]]
        if u.words:
            content = b" ".join(content.split())
        unit = p - int(unit0[row])
        least = seen.setdefault(content, me)
        if least < me:
            direct.append((row, unit, unit + q - p + u.width))
        elif not common:
            out.setdefault(to, []).append((block, row, me, unit, _FINAL, content))
        else:
            out.setdefault(first_to, []).append((block, row, me, unit, to if common == 1 else _BY_CONTENT, content))
    sent = [(to, block, b"S" + _pack(x)) for to, x in out.items()]
    if direct:
        sent.append((block % buckets, block, b"D" + _spans(*zip(*direct, strict=True))))
    return mail(sent)


def _judge(u: Units, engine: Engine, key: int, buckets: int, table: pa.Table) -> pa.Table:
    """Spans to the blocks (numbered from 0), and what is left of common segments to their next buckets (from -1 downwards)."""
    out, parts = [], []
    for sender, blob in zip(table["sender"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if blob[:1] == b"D":
            out.append((sender, key, blob[1:]))
        else:
            parts.append(_unpack(blob[1:]))
    if not parts:
        return mail(out)
    block, row, doc, pos, then = (np.concatenate([p[k] for p in parts]) for k in range(5))
    classes: dict[bytes, int] = {}
    cls = np.array([classes.setdefault(c, len(classes)) for p in parts for c in p[5]], np.int64)
    del parts
    least = np.full(len(classes), _NEVER)
    np.minimum.at(least, cls, doc)
    contents = list(classes)
    n = np.array([(c.count(b" ") + 1 if u.words else len(c)) - u.width + 1 for c in contents], np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    below = engine(contents, least) < np.repeat(least, n)
    whole = doc > least[cls]
    rows = [(block[whole], row[whole], pos[whole], pos[whole] + n[cls[whole]] + u.width - 1)]
    some = np.add.reduceat(below, at[:-1]) > 0
    on: dict[int, list] = {}
    for i in np.flatnonzero(~whole & (some[cls] | (then != _FINAL))).tolist():
        c = cls[i]
        mark = below[at[c] : at[c + 1]].view(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mark, [0]])))
        s, e = edge[::2], edge[1::2]
        if len(s):
            same = np.ones(len(s), np.int64)
            rows.append((same * block[i], same * row[i], pos[i] + s, pos[i] + e - 1 + u.width))
        if then[i] == _FINAL:
            continue
        words = contents[c].split(b" ") if u.words else contents[c]
        for p, q in zip([0, *e.tolist()], [*s.tolist(), len(mark)], strict=True):  # windows p to q - 1 are left
            for x, y in [(p, q)] * (p < q) if then[i] >= 0 else ((k, k + 1) for k in range(p, q)):
                content = words[x : y + u.width - 1]
                content = b" ".join(content) if u.words else content
                to = then[i] if then[i] >= 0 else xxhash.xxh32_intdigest(content) * buckets >> 32
                on.setdefault(int(to), []).append((block[i], row[i], doc[i], pos[i] + x, _FINAL, content))
    to, *span = (np.concatenate([r[k] for r in rows]) for k in range(4))
    order = np.argsort(to, kind="stable")
    to, span = to[order], [x[order] for x in span]
    out += [(b, key, _spans(*(x[s] for x in span))) for b, s in slices(to)]
    return mail(out + [(-1 - b, key, b"S" + _pack(x)) for b, x in on.items()])


OUT = [
    T.StructField("n_units", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def _apply(u: Units, docs: pa.Table, told: pa.Table, doc_id: str, text: str, keep: list[str], schema: pa.Schema) -> pa.Table:
    blobs = [np.frombuffer(b, np.int32).reshape(3, -1) for b in told["payload"].to_pylist()]
    row, s, e = np.concatenate(blobs, axis=1).astype(np.int64) if blobs else np.zeros((3, 0), np.int64)
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    where = dict(slices(row))
    place = np.argsort(_ordered(docs, doc_id)[1])
    n_units, n_removed, spans, kept = [], [], [], []
    texts = docs[text].cast(pa.binary()).to_pylist()
    for k, x in zip(place.tolist(), texts, strict=True):
        x = x or b""
        w = x.split() if u.words else x
        found, left = [], None
        if c := where.get(k):
            top = np.maximum.accumulate(e[c])
            new = np.flatnonzero(np.concatenate([[True], s[c][1:] > top[:-1]]))
            starts, ends = s[c][new].tolist(), top[np.append(new[1:], len(top)) - 1].tolist()
            found = [{"start": p, "end": q} for p, q in zip(starts, ends, strict=True)]
            bounds = list(zip([0, *ends], [*starts, len(w)], strict=True))
            left = [y for p, q in bounds for y in w[p:q]] if u.words else b"".join(w[p:q] for p, q in bounds)
        left = w if left is None else left
        n_units.append(len(w))
        n_removed.append(len(w) - len(left))
        spans.append(found)
        kept.append(b" ".join(left) if u.words else left)
    data = {c: docs[c] for c in keep} | {"n_units": n_units, "n_removed": n_removed, "spans": spans, "kept": kept}
    return pa.table([data[f.name] if isinstance(data[f.name], pa.ChunkedArray) else pa.array(data[f.name], pa.binary() if f.name == "kept" else f.type) for f in schema], schema.names).cast(schema)


def remove_repeats(docs: DataFrame, u: Units, engine: Engine, doc_id: str, text: str) -> DataFrame:
    """The documents with what is left of each, the number of units and the removed ranges.

    Adds ``kept`` (string for words, binary for bytes), ``n_units``,
    ``n_removed`` and ``spans`` (maximal ranges of units); input columns of
    these names are replaced, the others stay.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [f for f in docs.schema if f.name not in {"n_units", "n_removed", "spans", "kept"}]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *OUT, T.StructField("kept", T.StringType() if u.words else T.BinaryType())])
    arrow = to_arrow_schema(schema)
    blocks = block_count(docs, text, u.block)
    buckets = max(2 * runtime.partitions(docs.sparkSession), blocks // 2)
    x = dealt(docs.select(*names), doc_id, text, blocks)

    def anchors(key, t):
        return distinct_mail(key[0].as_py(), _anchor_runs(u, *tb.utf8(t[text]))[3], buckets)

    def segments(key, t, told):
        return _segments(u, t["__block"][0].as_py(), t, told, doc_id, text, blocks, buckets) if t.num_rows else mail([])

    def judge(key, t):
        return _judge(u, engine, key[0].as_py(), buckets, t)

    def judge_again(key, t):
        return _judge(u, engine, key[0].as_py(), buckets, t) if key[0].as_py() < 0 else t

    def apply(key, t, told):
        return _apply(u, t, told, doc_id, text, names, arrow)

    # All steps read the same columns, so that one shuffle of the texts serves them all.
    told = shared_values(x.groupBy("__block").applyInArrow(anchors, MAIL), u.hot, u.very_hot)
    sent = x.groupBy("__block").cogroup(told.groupBy("to")).applyInArrow(segments, MAIL)
    judged = sent.groupBy("to").applyInArrow(judge, MAIL).groupBy("to").applyInArrow(judge_again, MAIL)
    return x.groupBy("__block").cogroup(judged.groupBy("to")).applyInArrow(apply, schema)
