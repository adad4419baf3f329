"""Word passages that repeat across documents (a compressed FM-index per shard).

Each bucket of segments is a shard. Its FM-index holds the Burrows-Wheeler
transform of the shard's distinct segments in a wavelet matrix; the segments
are then streamed against it: a backward search from each word extends the
match to the left, one word a step, until it is unique or as long as the
threshold. That gives the matching statistics up to the threshold, and the
suffix range of each match tells the smallest document that holds it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.repeats import Units, remove_repeats

WIDTH = 13
FIRST = 4  # words that the table of first steps covers


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector with block counts a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), []
        s = symbols
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (s >> shift & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)
            zeros = self.n - int(bit.sum())
            self.levels.append((shift, packed, ones, zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position, plus where its run begins."""
        for shift, packed, ones, zeros in self.levels:
            word = at >> 6
            below = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            one = ones[word] + np.bitwise_count(below)
            at = np.where(symbol >> shift & 1, zeros + one, at - one)
        return at


def _rank(*parts: np.ndarray) -> np.ndarray:
    key = parts[0].astype(np.uint64)
    for p in parts[1:]:
        key = key << np.uint64(32) | p.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _ahead(r: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([r[k:], np.zeros(min(k, len(r)), r.dtype)])


class FMIndex:
    """Index over segments of words; suffixes are ordered through ``depth`` words."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.text, self.depth = text, depth
        rank, size, self.first = text.astype(np.int64), 1, None
        while size * 2 <= depth:
            rank = _rank(rank, _ahead(rank, size))
            size *= 2
            if size == FIRST:
                self.first = rank
        if size < depth:
            rank = _rank(rank, _ahead(rank, depth - size))
        self.suffixes = np.argsort(rank, kind="stable")
        count = np.bincount(text, minlength=sigma)
        self.base = np.concatenate([[0], np.cumsum(count)])[:-1]
        self.bwt = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.zero = self.bwt.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def ranges_of_first(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of the first FIRST words of each suffix."""
        count = np.cumsum(np.bincount(self.first))
        hi = count[self.first]
        return hi - np.bincount(self.first)[self.first], hi

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of the backward search: ranges of the matches with a word put before them."""
        base = self.base[symbol] - self.zero[symbol]
        return base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)


def fm_engine(contents: list[bytes], least: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The smallest document of each window, by backward search over the shard's index."""
    split = [c.split(b" ") for c in contents]
    ids: dict[bytes, int] = {}
    size = np.array(list(map(len, split)), np.int64)
    flat = np.fromiter((ids.setdefault(w, len(ids) + 1) for s in split for w in s), np.int64, size.sum())
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # each segment ends with symbol 0
    text = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)
    text[inside] = flat
    owner = np.repeat(least, size + 1)
    n = size - width + 1
    start = np.arange(n.sum()) + np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    smallest = np.repeat(least, n)
    index = FMIndex(text, len(ids) + 1, width)
    if width >= FIRST and index.first is not None:
        lo, hi = index.ranges_of_first()
        matched = FIRST
        lo, hi = lo[start + width - FIRST], hi[start + width - FIRST]
    else:
        matched, lo, hi = 0, np.zeros(len(start), np.int64), np.full(len(start), len(text))
    live = np.arange(len(start))
    while True:
        many = hi - lo > 1  # a window that only its own segment holds needs no longer match
        live, lo, hi = live[many], lo[many], hi[many]
        if matched == width or not len(live):
            break
        lo, hi = index.step(text[start[live] + width - 1 - matched], lo, hi)
        matched += 1
    if len(live):
        bounds, inverse = np.unique(lo, return_index=True)[0], None
        first = np.unique(lo, return_index=True)[1]
        ends, owners = hi[first], owner[index.suffixes]
        edges = np.stack([bounds, ends], 1).ravel()
        m = np.minimum.reduceat(np.append(owners, np.iinfo(np.int64).max), edges)[::2]
        inverse = np.searchsorted(bounds, lo)
        smallest[live] = np.minimum(smallest[live], m[inverse])
    return smallest


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Remove each word covered by a width-word window that also starts in a smaller document.

    Words are runs of characters other than space and U+0009-U+000D, compared
    as they stand; windows are judged on the input. Null, empty and short texts
    have no window; a null id is smaller than no other and larger than all;
    rows that share an id don't remove each other's words. Returns the input's
    columns with ``kept`` (the words left, joined by one space), ``n_units``
    (words), ``n_removed`` and ``spans``, the maximal removed ranges of words.
    """
    gram = max(1, (width + 1) // 2)
    return remove_repeats(docs, Units(True, width, gram), lambda c, m: fm_engine(c, m, width), doc_id, text)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_passages(docs).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), g AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS passage FROM w
), first AS (
  SELECT passage, min(doc_id) AS least FROM g WHERE i <= n - 12 GROUP BY passage
), hits AS (
  SELECT g.doc_id, word, i, coalesce(least < g.doc_id, false) AS hit FROM g LEFT JOIN first ON g.passage = first.passage AND i <= n - 12
), marked AS (
  SELECT doc_id, word, i, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hits
)
SELECT d.doc_id, count(i)::BIGINT AS n_words, (count(i) FILTER (gone))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
