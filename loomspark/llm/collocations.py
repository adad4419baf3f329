"""Phrase collocations by mining each n-gram where its rarest word is.

Words of each language are counted. Texts are rewritten to ids of frequent
words, rarer words with larger ids; others end a run, as no frequent phrase
goes over them. Around each word stands the fragment of up to four neighbours
on each side that are more frequent: the n-grams whose rarest word (the first
of equal ones) it is lie there and nowhere else. Equal fragments are added up
in their task and dealt out by that word; each bucket counts the n-grams of its
own words alone, so a phrase is counted in one place. Frequent words give short
fragments, so no word makes a large bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.llm import textbytes as tb
from loomspark.llm.arrow import pieces

MOST = 5  # words in a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000
LISTED = 1 << 19  # most words that are broadcast, with at most WIDEST bytes each; the others go by a hash
WIDEST = 64
HELD = 1_000_000  # fragments that a task adds up at a time
PER_BUCKET = 2_000_000  # words of the corpus whose fragments share a bucket
UNKNOWN = "und"
_BASE = 1 << 31  # ids of words that aren't listed lie above

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUT = _END.copy()
_OUT[[0x20, 0x09]] = True
_ODD = np.random.default_rng(12).integers(1, 1 << 62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _words(batch: pa.RecordBatch):
    """Of a batch of (lang, text): bytes; start, end and language number of each word; whether it follows the one before it in a piece; its key; language names."""
    raw, off = tb.utf8(batch.column(1))
    low = _LOWER[raw]
    s, e, doc = tb.spans(~_OUT[low], off)
    ends = np.concatenate([[0], np.cumsum(_END[low])])
    follows = np.zeros(len(s), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (ends[s[1:]] == ends[s[:-1]])
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    lang = np.array(langs.indices, np.int64)[doc]
    h = tb.span_hash(tb.prefix(low), s, e)
    salt = _lang_keys(names)
    return low, s, e, lang, follows, _key(h, salt[lang]) if len(h) else h, names


def _lang_keys(names: list[str]) -> np.ndarray:
    raw, off = tb.utf8(pa.array(names, pa.string()))
    return tb.span_hash(tb.prefix(raw), off[:-1], off[1:])


def _key(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Keys of words in languages; a word may be its language's name."""
    return tb.mix(word * _ODD[14] + lang)


def _in_lang(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)), F.col(text))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): occurrences of each word, and under the empty word those of all words of the language."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                low, s, e, of, _, key, names = _words(b)
                _, one, n = np.unique(key, return_index=True, return_counts=True)
                idx, at = tb.ragged(s[one], (e - s)[one])
                total = np.bincount(of, minlength=len(names))
                words = pa.concat_arrays([tb.strings(low[idx], at), pa.array([""] * len(names), pa.string())])
                langs = pa.array(names, pa.string()).take(pa.array(np.concatenate([of[one], np.arange(len(names))])))
                yield pa.RecordBatch.from_arrays([langs, words, pa.array(np.concatenate([n, total]))], ["lang", "word", "n"])

    return _in_lang(docs, text, lang).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """(lang, word, n, key): ``words`` with the key under which texts look them up."""

    def run(batches):
        for b in batches:
            langs = b.column(0).dictionary_encode()
            raw, off = tb.utf8(b.column(1))
            h = tb.span_hash(tb.prefix(raw), off[:-1], off[1:])
            key = _key(h, _lang_keys(langs.dictionary.to_pylist())[np.array(langs.indices, np.int64)]) if len(h) else h
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], ["lang", "word", "n", "key"])

    return words.mapInArrow(run, "lang string, word string, n long, key long")


class _Ids:
    """Ids of listed words: their rank by falling count, then key."""

    def __init__(self, table: pa.Table, complete: bool):
        key, n = np.array(table["key"]).view(np.uint64), np.array(table["n"])
        order = np.lexsort((key, -n))
        table = table.take(pa.array(order)).combine_chunks()
        self.n, self.words = n[order], table["word"].combine_chunks()
        lang = table["lang"].combine_chunks().dictionary_encode()
        self.lang, self.langs = np.array(lang.indices, np.int32), lang.dictionary.to_pylist()
        key = key[order]
        self.rank = np.argsort(key).astype(np.int32)
        self.keys = key[self.rank]
        self.complete = complete

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Ids of keys; -1 for words that aren't frequent, or above ``_BASE`` where the list can't tell."""
        if not len(self.keys):
            return np.full(len(key), -1, np.int64) if self.complete else (key >> np.uint64(2)).astype(np.int64) | _BASE
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        if self.complete:
            return np.where(there, self.rank[at], -1).astype(np.int32)
        return np.where(there, self.rank[at].astype(np.int64), (key >> np.uint64(2)).astype(np.int64) | _BASE)


def _fragments(ids: np.ndarray, follows: np.ndarray, most: int) -> np.ndarray:
    """For each word with a neighbour in its fragment, the fragment with the word in the middle; -1 beside it."""
    k, n = most - 1, len(ids)
    pad = np.full(k, -1, ids.dtype)
    x = np.concatenate([pad, ids, pad])
    linked = np.concatenate([np.zeros(k, bool), follows, np.zeros(k, bool)])  # with the word before
    out = np.full((n, 2 * k + 1), -1, ids.dtype)
    out[:, k] = ids
    left, right = ids >= 0, ids >= 0
    for j in range(1, k + 1):
        before, after = x[k - j : k - j + n], x[k + j : k + j + n]
        left = left & linked[k - j + 1 : k - j + 1 + n] & (before >= 0) & (before < ids)
        right = right & linked[k + j : k + j + n] & (after >= 0) & (after <= ids)
        out[:, k - j] = np.where(left, before, -1)
        out[:, k + j] = np.where(right, after, -1)
    return out[(out[:, k - 1] >= 0) | (out[:, k + 1] >= 0)]


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h += tb.mix((rows[:, c].astype(np.uint64) + np.uint64(2)) * _ODD[c])
        h *= _ODD[15]
    return h


def _added_up(rows: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with their sums of ``n`` of ``least`` or more. Rows of one hash are compared."""
    if not len(rows):
        return rows, n
    _, one, group = np.unique(_row_hash(rows), return_index=True, return_inverse=True)
    total = np.bincount(group, n, len(one)).astype(np.int64)
    enough = total >= least  # other rows of the same hash could only make a sum too large
    use = enough[group]
    same = (rows[use] == rows[one[group[use]]]).all(1)
    if not same.all():
        mixed = np.isin(group, np.unique(group[use][~same]))
        told: dict = {}
        for r, m in zip(map(tuple, rows[mixed].tolist()), n[mixed].tolist(), strict=True):
            told[r] = told.get(r, 0) + m
        told = {r: m for r, m in told.items() if m >= least}
        rest, sums = _added_up(rows[~mixed], n[~mixed], least)
        return np.concatenate([rest, np.array([*told], rows.dtype).reshape(-1, rows.shape[1])]), np.concatenate([sums, np.array([*told.values()], np.int64)])
    return rows[one[enough]], total[enough]


def _owned(rows: np.ndarray, n: np.ndarray, most: int, least: int):
    """(n-grams, sums) of 2 to ``most`` words that hold the word in the middle of fragments."""
    k = most - 1
    for size in range(2, most + 1):
        found = [(rows[:, c : c + size], (rows[:, c] >= 0) & (rows[:, c + size - 1] >= 0)) for c in range(k - size + 1, k + 1)]
        yield _added_up(np.concatenate([x[ok] for x, ok in found]), np.concatenate([n[ok] for _, ok in found]), least)


def frequent_phrases(docs: DataFrame, counts: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """(lang, words, f, first_n, last_n): phrases of 2 to ``most`` words with f of ``least`` or more.

    ``counts`` are those of ``word_counts``. ``first_n`` and ``last_n`` are the
    counts of the outer words. At most ``listed`` words of up to ``WIDEST``
    bytes are broadcast, the most frequent ones; further frequent words are
    told by their hash and count as rarer, which costs only longer fragments.
    """
    spark = docs.sparkSession
    words = runtime.stored(_keyed(counts.where((F.col("word") != "") & (F.col("n") >= least)).select("lang", "word", "n")))
    size = F.floor(F.log2("n") * 16).cast("int")
    short = F.octet_length("word") + F.octet_length("lang") <= WIDEST
    steps = sorted(((r.s, r.m) for r in words.where(short).groupBy(size.alias("s")).agg(F.count("*").alias("m")).collect()), reverse=True)  # a row for each size, of which there are at most 1,024
    held, limit = 0, None
    for s, m in steps:
        if held + m > listed:
            break
        held, limit = held + m, s
    chosen = short & (size >= limit) if limit is not None else F.lit(False)
    complete = held == words.count()
    ids = spark.sparkContext.broadcast(_Ids(words.where(chosen).toArrow(), complete))  # at most ``listed`` rows
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    buckets = max(runtime.partitions(spark), total // PER_BUCKET)
    k, kind = most - 1, np.int32 if complete else np.int64

    def flush(held: list[np.ndarray]):
        rows = np.concatenate(held)
        rows, n = _added_up(rows, np.ones(len(rows), np.int64), 1)
        bucket = (tb.mix(rows[:, k].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, n, bucket = rows[order], n[order], bucket[order]
        mask = rows >= 0
        shape = (mask[:, :k].sum(1) * (k + 1) + mask[:, k + 1 :].sum(1)).astype(np.uint8)
        at = np.concatenate([[0], np.cumsum(mask.sum(1))])
        flat = rows[mask]
        first = tb.runs(bucket)
        end = np.append(first[1:], len(bucket))
        cut = list(zip(first.tolist(), end.tolist(), strict=True))
        columns = [bucket[first], *(pa.array([x[lo:hi].tobytes() for lo, hi in cut], pa.binary()) for x in (shape, n)), pa.array([flat[at[lo] : at[hi]].astype(kind).tobytes() for lo, hi in cut], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["bucket", "shape", "n", "ids"])

    def deal(batches):
        held, rows = [], 0
        for whole in batches:
            for b in pieces(whole):
                _, _, _, _, follows, key, _ = _words(b)
                held.append(_fragments(ids.value(key), follows, most))
                rows += len(held[-1])
                if rows >= HELD:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    def mine(table: pa.Table) -> pa.Table:
        shape, n, flat = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("shape", np.uint8), ("n", np.int64), ("ids", kind)))
        left, right = shape // (k + 1), shape % (k + 1)
        column = np.arange(2 * k + 1)
        rows = np.full((len(n), 2 * k + 1), -1, kind)
        rows[(column >= k - left[:, None]) & (column <= k + right[:, None])] = flat
        x, out = ids.value, []
        for grams, f in _owned(rows, n, most, least):
            known = grams < _BASE
            at = np.where(known, grams, 0).astype(np.int64)
            words = x.words.take(pa.array(at.ravel(), mask=~known.ravel())) if len(x.words) else pa.nulls(grams.size, pa.string())
            bounds = pa.array(np.arange(len(grams) + 1, dtype=np.int32) * grams.shape[1])
            langs = [x.langs[x.lang[a[m][0]]] if m.any() else None for a, m in zip(at, known, strict=True)]
            outer = [pa.array(x.n[at[:, c]] if len(x.n) else np.zeros(len(at), np.int64), mask=~known[:, c]) for c in (0, -1)]
            out.append(pa.table([pa.array(langs, pa.string()), pa.ListArray.from_arrays(bounds, words), pa.ListArray.from_arrays(bounds, pa.array(grams.ravel().astype(np.int64))), pa.array(f), *outer], ["lang", "words", "ids", "f", "first_n", "last_n"]))
        return pa.concat_tables(out)

    dealt = _in_lang(docs, text, lang).mapInArrow(deal, "bucket int, shape binary, n binary, ids binary")
    found = dealt.groupBy("bucket").applyInArrow(mine, "lang string, words array<string>, ids array<long>, f long, first_n long, last_n long")
    if complete:
        return found.drop("ids")
    found = runtime.stored(found)  # words that aren't listed get their names by a join
    rest = words.where(~chosen).select(F.shiftrightunsigned("key", 2).bitwiseOR(F.lit(_BASE)).alias("id"), "lang", "word", "n")
    named = found.select("ids", F.posexplode("ids").alias("at", "id")).join(rest, "id").groupBy("ids")
    named = named.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("word", "n")))).alias("__m"), F.first("lang").alias("__l"))
    x = found.join(named, "ids", "left").withColumn("__m", F.coalesce("__m", F.expr("cast(map() as map<int, struct<word: string, n: bigint>>)")))
    at = lambda k: F.try_element_at("__m", k)
    return x.select(
        F.coalesce("lang", "__l").alias("lang"),
        F.transform("words", lambda w, k: F.coalesce(w, at(k)["word"])).alias("words"),
        "f",
        F.coalesce("first_n", at(F.lit(0))["n"]).alias("first_n"),
        F.coalesce("last_n", at(F.size("ids") - 1)["n"]).alias("last_n"),
    )


def _quotient(a, n, l, r):
    """floor(1000 * a * n / (l * r)), exact."""
    big = [F.col(x).cast("decimal(19,0)") if isinstance(x, str) else x.cast("decimal(19,0)") for x in (a, n, l, r)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big[0] * big[1], big[2] * big[3])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST, top: int | None = TOP, listed: int = LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    a is the phrase's count, l and r those of its parts at the cut of lowest
    score, floor(1000 * a * n / (l * r)), n the words of the language. Phrases
    that hold as often as a longer candidate around them are left out. ``top``
    None returns all, without a rank. A null language counts as "und"; a null
    text has no word; an empty table gives none. ``listed`` as in
    ``frequent_phrases``.
    """
    counts = runtime.stored(word_counts(docs, text, lang).where((F.col("word") == "") | (F.col("n") >= least)))
    phrases = frequent_phrases(docs, counts, text, lang, most, least, listed)
    phrases = runtime.stored(phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f", "first_n", "last_n"))
    size = F.size("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda k: F.filter(F.array(F.struct((2 * k).alias("at"), F.slice("words", F.lit(1), k).alias("part")), F.struct((2 * k + 1).alias("at"), F.slice("words", k + 1, size - k).alias("part"))), lambda p: F.size(p["part"]) > 1),
        )
    )
    parts = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), "first_n", "last_n", F.explode_outer(inner).alias("p")).withColumn("part", F.array_join("p.part", " ")).withColumn("at", F.col("p.at")).drop("p")
    there = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_n"))
    met = parts.join(there, ["lang", "part"], "left").groupBy("lang", "phrase", "words", "a", "first_n", "last_n")
    met = met.agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "part_n")))).alias("m"))  # at most 2 * (most - 1) parts
    totals = counts.where("word = ''").select("lang", "n")
    met = met.join(totals, "lang")

    def cut(k):
        l = F.when(k == 1, F.col("first_n")).otherwise(F.try_element_at("m", 2 * k))
        r = F.when(k == size - 1, F.col("last_n")).otherwise(F.try_element_at("m", 2 * k + 1))
        return F.struct(_quotient("a", "n", l, r).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    met = met.withColumn("cuts", F.transform(F.sequence(F.lit(1), size - 1), cut)).withColumn("best", F.array_min("cuts"))
    scored = runtime.stored(met.select("lang", "phrase", "words", "a", "n", "cuts", "best"))
    # a longer candidate as frequent as a shorter one in it, so each one between them is; one word more is enough
    ends = F.array(
        F.when(F.element_at("cuts", -1)["l"] == F.col("a"), F.array_join(F.slice("words", F.lit(1), size - 1), " ")),
        F.when(F.element_at("cuts", 1)["r"] == F.col("a"), F.array_join(F.slice("words", F.lit(2), size - 1), " ")),
    )
    covered = scored.where(size > 2).select("lang", F.explode(ends).alias("phrase")).where("phrase is not null").distinct()
    kept = scored.join(covered, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    if top is None:
        return kept
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("__b", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__k", F.row_number().over(Window.partitionBy("lang", "__b").orderBy(*order))).where(F.col("__k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # at most 64 * top rows of a language
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = r"""WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, g, size, count(*) AS f FROM (SELECT lang, size, unnest([array_to_string(w[i + 1:i + size], ' ') FOR i IN range(greatest(0, len(w) - size + 1))]) AS g FROM pieces, range(1, 6) t(size)) GROUP BY ALL HAVING count(*) >= 100),
candidates AS MATERIALIZED (SELECT lang, g, size, f, string_split(g, ' ') AS w FROM grams WHERE size > 1),
cuts AS (SELECT lang, g, f, k, array_to_string(w[1:k], ' ') AS a, array_to_string(w[k + 1:], ' ') AS b FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.a JOIN grams y ON y.lang = c.lang AND y.g = c.b JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, f, unnest(flatten([[array_to_string(w[i + 1:i + s], ' ') FOR i IN range(size - s + 1)] FOR s IN range(2, size)])) AS g FROM candidates),
covered AS (SELECT DISTINCT c.lang, c.g FROM candidates c JOIN inner_parts p ON p.lang = c.lang AND p.g = c.g WHERE 100 * p.f >= 100 * c.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best ANTI JOIN covered USING (lang, g))
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
