"""Byte passages that repeat across documents (depth-limited suffix sorting).

Each bucket orders the suffixes of its segments only through ``width`` bytes,
by most-significant-digit passes over 8-byte digits: a pass sorts each group of
suffixes that are equal so far by the next digit, and groups of one leave the
sort. What is left after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textbytes as tb
from loomspark.llm.repeats import Units, remove_repeats

WIDTH = 50
PART = 1 << 17  # suffixes that one part of a sort should hold
BLOCK = 1_000_000  # a block's arrays take some 130 bytes for each byte of text


def _digits(buf: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The big-endian number of the 8 bytes at each position; buf ends with 8 spare bytes."""
    d = np.zeros(len(pos), np.uint64)
    for k in range(8):
        d <<= np.uint64(8)
        d |= buf[pos + k]
    return d


def equal_suffixes(buf: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into pos of suffixes whose first width bytes repeat, in groups, and the group starts."""
    left, group = np.arange(len(pos)), np.zeros(len(pos), np.int64)
    for depth in range(0, width, 8):
        if not len(left):
            break
        key = _digits(buf, pos[left] + depth)
        if (over := depth + 8 - width) > 0:
            key = key >> np.uint64(8 * over)
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        left, group, key = left[order], group[order], key[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        left, group = left[many], group[many]
    return left, tb.runs(group)


def radix_engine(contents: list[bytes], least: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The smallest document of each window, by sorting the windows' suffixes."""
    size = np.array(list(map(len, contents)), np.int64)
    n = size - width + 1
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    pos = np.arange(n.sum()) + np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    pos, smallest = pos.astype(np.int32), np.repeat(least, n)
    buf = np.frombuffer(b"".join([*contents, bytes(8)]), np.uint8)
    # The first pass deals suffixes out by their first byte; bytes of few suffixes share a part.
    lead = buf[pos]
    by = np.argsort(lead, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(lead, minlength=256))
    start = 0
    for k, end in enumerate(ends.tolist()):
        if end - start < PART and k < 255:
            continue
        part = by[start:end]
        left, group = equal_suffixes(buf, pos[part], width)
        if len(left):
            left = part[left]
            m = np.minimum.reduceat(smallest[left], group)
            smallest[left] = np.repeat(m, np.diff(np.append(group, len(left))))
        start = end
    return smallest


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Remove each byte covered by a width-byte string that also starts in a smaller document.

    Texts count as UTF-8 bytes; matches never cross documents and are judged on
    the input. Null or empty texts give 0 bytes; a null id is smaller than no
    other and larger than all; rows that share an id don't remove each other's
    bytes. Returns the input's columns with ``kept`` (binary), ``n_units``
    (bytes), ``n_removed`` and ``spans``, the maximal removed ranges.
    """
    gram = max(1, width * 2 // 5)
    return remove_repeats(docs, Units(False, width, gram, BLOCK), lambda c, m: radix_engine(c, m, width), doc_id, text)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


OP5_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT doc_id, k, substr(h, 400 * k + 1, 498) AS part FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 399) // 400)) AS k FROM d)
), g AS (
  SELECT doc_id, 200 * k + j AS i, substr(part, 2 * j - 1, 2) AS byte, substr(part, 2 * j - 1, 100) AS string
  FROM (SELECT doc_id, k, part, unnest(range(1, least(200, len(part) // 2) + 1)) AS j FROM parts)
), first AS (
  SELECT string, min(doc_id) AS least FROM g WHERE len(string) = 100 GROUP BY string
), hits AS (
  SELECT g.doc_id, byte, i, coalesce(least < g.doc_id, false) AS hit FROM g LEFT JOIN first ON g.string = first.string
), marked AS (
  SELECT doc_id, byte, i, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM marked
)
SELECT d.doc_id, count(i)::BIGINT AS n_bytes, (count(i) FILTER (gone))::BIGINT AS n_removed, (count(i) FILTER (edge))::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM documents d LEFT JOIN edges e ON d.doc_id = e.doc_id GROUP BY d.doc_id
"""
