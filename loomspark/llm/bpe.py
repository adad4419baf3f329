"""Byte-pair encoding with a contiguous rank array for each short word.

A word is held as the ids of its parts and, beside them, the merge rank of each
two neighbours. The smallest rank is looked for by scanning; its boundary is
deleted and the ranks beside it are looked up anew. The new words of a batch go
through this together: those of as many parts are the rows of one array, and
each step leaves all of them one part shorter. Words longer than ``LONG`` bytes
go through a heap of the same ranks, for which scanning would be quadratic.
Every task keeps the encodings of words that it has met, up to a fixed number.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.arrow import with_columns

LONG = 256
CACHE = 300_000
_NONE = 1 << 40
# Fixed values of byte-level BPE: the pattern of words, and the printable characters that stand for bytes.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")  # behind a space, one word


def _bytes_of() -> dict[str, int]:
    other = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    """Encoder and decoder made from the text of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        of, vocab = _bytes_of(), j["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.unit = [0] * 256
        for c, b in of.items():
            self.unit[b] = vocab[c]
        self.pairs, self.made = {}, []
        for rank, pair in enumerate(j["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        keys = np.array([*self.pairs, 1 << 62], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([*self.pairs.values(), _NONE], np.int64)[order]
        self.of_byte, self.of_rank = np.array(self.unit, np.int64), np.array(self.made, np.int64)
        first = self._ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.of_bytes = first.reshape(256, 256)  # ranks of two bytes
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}  # behind a space, without it, or from a line break on
        self.older: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) > LONG:
            return self._merge_long(word)
        part = [self.unit[b] for b in word]
        find, made = self.pairs.get, self.made
        rank = [find(a << 20 | b, _NONE) for a, b in zip(part, part[1:])]  # noqa: B905
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            k = rank.index(least)
            part[k] = made[least]
            del part[k + 1], rank[k]
            if k:
                rank[k - 1] = find(part[k - 1] << 20 | part[k], _NONE)
            if k < len(rank):
                rank[k] = find(part[k] << 20 | part[k + 1], _NONE)
        return part

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words that aren't empty nor longer than ``LONG``: as by ``merge``, for all at once."""
        out, by_size = [b""] * len(words), defaultdict(list)
        for i, word in enumerate(words):
            by_size[len(word)].append(i)
        which, part, rank = np.zeros(0, np.int64), None, None
        for n in range(max(by_size, default=0), 0, -1):  # parts of a word
            if n in by_size:
                raw = np.frombuffer(b"".join(words[i] for i in by_size[n]), np.uint8).reshape(-1, n)
                new, ranks = self.of_byte[raw], self.of_bytes[raw[:, :-1], raw[:, 1:]]
                part, rank = (np.concatenate([part, new]), np.concatenate([rank, ranks])) if len(which) else (new, ranks)
                which = np.concatenate([which, np.array(by_size[n], np.int64)])
            if not len(which):
                continue
            row = np.arange(len(which))
            at = rank.argmin(1) if n > 1 else np.zeros(len(which), np.int64)
            least = rank[row, at] if n > 1 else np.full(len(which), _NONE)
            done = least == _NONE
            if done.any():
                ids = part[done].astype("<u4").tobytes()
                for k, i in enumerate(which[done].tolist()):
                    out[i] = ids[4 * n * k : 4 * n * (k + 1)]
                go = ~done
                which, part, rank, at, least = which[go], part[go], rank[go], at[go], least[go]
                row = np.arange(len(which))
            if not len(which):
                continue
            part[row, at] = self.of_rank[least]
            kept = np.ones(part.shape, bool)
            kept[row, at + 1] = False
            part = part[kept].reshape(len(row), n - 1)
            kept = np.ones(rank.shape, bool)
            kept[row, at] = False
            rank = rank[kept].reshape(len(row), n - 2)
            r = np.flatnonzero(at > 0)
            k = at[r]
            rank[r, k - 1] = self._ranks(part[r, k - 1], part[r, k])
            r = np.flatnonzero(at < n - 2)
            k = at[r]
            rank[r, k] = self._ranks(part[r, k], part[r, k + 1])
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        part = [self.unit[b] for b in word]
        n, find = len(part), self.pairs.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := find(part[k] << 20 | part[k + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            q = right[k]
            if part[k] < 0 or q >= n or find(part[k] << 20 | part[q], _NONE) != r:
                continue
            part[k], part[q] = self.made[r], -1
            right[k] = right[q]
            if right[k] < n:
                left[right[k]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < n and (x := find(part[a] << 20 | part[b], _NONE)) < _NONE:
                    heapq.heappush(heap, (x, a))
        return [p for p in part if p >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = np.array(self.merge(word.encode()), "<u4").tobytes()
            if len(word) <= LONG:
                self.words[word] = ids
        return ids

    def _learn(self, words: set[str]) -> list[str]:
        """Put the ids of all ``words`` into ``self.words``; returns those too long to stay there."""
        new = words - self.words.keys()
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = words
        long, short, raw = [], [], []
        for word in new:
            b = word.encode()
            if len(b) > LONG:
                long.append(word)
                self.words[word] = np.array(self._merge_long(b), "<u4").tobytes()
            else:
                short.append(word)
                raw.append(b)
        self.words.update(zip(short, self.merge_all(raw), strict=True))
        return long

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers; none of a null or empty text."""
        single, spaced, met = {}, {}, set()
        for i, t in enumerate(texts):
            if not t or (self.split and any(x in t for x in self.special)):
                continue
            if len(" ".join(t.split())) != len(t):  # runs of white space reach over single spaces
                spaced[i] = _WORD.findall(t)
            else:  # else no word reaches over a space, and a line break is a word
                single[i] = t.replace("\n", " \n").split(" ")
                spaced[i] = _WORD.findall(single[i].pop(0))
                met.update(single[i])
        fresh = met - self.chunks.keys()
        known = fresh & self.older.keys()
        self.chunks.update(zip(known, map(self.older.__getitem__, known), strict=True))
        fresh -= known
        whole = [x for x in fresh if len(x) < LONG // 2 and _LETTERS.fullmatch(x)]
        fresh.difference_update(whole)
        self.chunks.update(zip(whole, self.merge_all([(" " + x).encode() for x in whole]), strict=True))
        found = [_WORD.findall(x if x[0] == "\n" else " " + x) for x in fresh]
        rare = self._learn(set().union(*found, *spaced.values()))
        get = self.words.__getitem__
        self.chunks.update(zip(fresh, [b"".join(map(get, f)) for f in found], strict=True))
        behind = self.chunks.__getitem__
        out = [b"".join([*map(get, spaced[i]), *map(behind, single.get(i, ()))]) if i in spaced else self.encode(t) if t else b"" for i, t in enumerate(texts)]
        for kept, long in ((self.words, rare), (self.chunks, [x for x in fresh if len(x) > LONG])):
            for x in long:
                kept.pop(x, None)
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.chunks) > CACHE // 2:  # what isn't met before the next turn goes
            self.older = self.chunks if len(self.chunks) <= CACHE else {}
            self.chunks = {}
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.split and any(t in text for t in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, _WORD.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[int, ByteBPE] = {}


def _coder(spec) -> ByteBPE:
    """One coder for each tokenizer and worker."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(spec.value)
    return _loaded[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens``.

    The tokenizer file at ``path`` is read on the driver and broadcast. Its
    special tokens count as such where they stand in a text. Null and empty
    texts give no ids; input columns named ids or n_tokens are replaced.
    """
    with open(path or default_tokenizer()) as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> list:
        coder = _coder(spec)
        ids = coder.encode_all(batch.column(text).to_pylist())
        return [ids, [len(x) // 4 for x in ids]]

    return with_columns(docs, run, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the text of packed ids; null ids give an empty text."""
    with open(path or default_tokenizer()) as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> list:
        coder = _coder(spec)
        return [[coder.decode(x or b"") for x in batch.column(ids).to_pylist()]]

    return with_columns(docs, run, [T.StructField("decoded", T.StringType())])


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(decode(encode(docs).drop("text")))
