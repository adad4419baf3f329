import hashlib
import re
from math import log

import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import fingerprints, licences, mixing

SF = "/root/testdata/sf0.001"


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({b for _, b in at}))


def test_licences_same_as_listing(spark):
    odd = [None, "", "MIT License", "mit-license. Apache\nLICENSE apache license", "éMIT License", "mit licenses", "Mİt license", "gnu general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Released under the MIT License! mit mit license" * 30, "general general public license x" * 300]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate([*odd, odd[2]], 10**6)), "doc_id long, text string"))
    got = licences.scan(docs.withColumn("labels", F.lit("mine"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(r.text), r.text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[10**6 + 8].labels == "mit" and by[10**6 + 8].n_base == 0 and by[10**6 + 7].labels == "gpl"
    assert licences.scan(docs.limit(0)).count() == 0


def brute_matches(text):
    words, out = re.findall("[a-z0-9]+", text.lower()), []
    for label, passage, key in licences.TEMPLATES:
        p, q = passage.split(), key.split()
        start = next(k for k in range(len(p)) if p[k : k + len(q)] == q)
        for at in range(-start, len(words)):
            if words[at + start : at + start + len(q)] == q:
                share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(p)) / len(p)
                out.append((label, at + start, pytest.approx(share)))
    return out


@pytest.mark.parametrize("up", [True, False])
def test_licences_find_every_key_phrase_among_all_template_words(spark, up):
    words = sorted({w for _, passage, _ in licences.TEMPLATES for w in passage.split()})
    weights = {w: 1 + k / 100 for k, w in enumerate(words if up else words[::-1])}
    passages, keys = [p for _, p, _ in licences.TEMPLATES], [k for _, _, k in licences.TEMPLATES]
    texts = [" ".join(words) + " x " + " y ".join(part) + " " + " ".join(words[::-1]) for part in (passages, keys, passages * 3)] + keys + passages
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for w in (weights, None):
        for r in licences.scan(docs, weights=w).collect():
            want = brute_matches(r.text)
            assert [tuple(m) for m in r.matches] == want, r.text
            assert set(r.labels.split(",")) == {label for label, *_ in want} | set(filter(None, r.base_labels.split(",")))


def brute_next(rows):
    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))
    return {ordered[k][0]: ordered[(k + 1) % len(ordered)][1] for k in range(len(ordered))}


@pytest.mark.parametrize("few", [10_000, 2])
def test_edited_text_and_likeness(spark, few, monkeypatch):
    rows = [(k * 700, f"text {k} " * (k % 7)) for k in range(60)] + [(-5, "ab"), (None, "é😀x"), (10**15, "one two three four five six seven"), (3, None)]
    monkeypatch.setattr(fingerprints._next_lower, "__defaults__", (few,))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: r for r in fingerprints.with_next(docs, "doc_id", ["text"]).collect()}
    want = brute_next([(i, t or "") for i, t in rows])
    assert {i: r.next_text for i, r in got.items()} == want


def test_fingerprints_on_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ahead = brute_next(list(texts.items()))
    rows = fingerprints.op8_fingerprints(spark, SF).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        t = texts[r.doc_id]
        k = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + ahead[r.doc_id][:k]).encode()).hexdigest() and r.n_chars == len(t)
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in rows if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.8 * len(long)


def xx(*values):
    """Spark's xxhash64 of longs and strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def xx_int(x, o):
    """The same of a long and an int, which Spark hashes as 4 bytes."""
    h = xxhash.xxh64_intdigest((o & (1 << 32) - 1).to_bytes(4, "little"), xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), 42))
    return h - (1 << 64) if h >> 63 else h


def brute_sketch(text):
    words = re.findall(r"[^ \t\n\x0B\f\r]+", text or "")
    grams = [xx(*words[k : k + 5]) for k in range(len(words) - 4)] or ([xx(" ".join(words))] if words else [])
    numbered = [xx_int(x, grams[:k].count(x)) for k, x in enumerate(grams)]
    out = []
    for h in range(fingerprints.HASHES):
        values = [xx_int(x, h) for x in numbered]
        for start in fingerprints.STARTS if values else []:
            least = sorted(values, key=lambda x: (x - start) % (1 << 64))[: fingerprints.TUPLE]
            out.append(xx(*sorted(least, key=values.index)))
    return out


def test_sketch_same_as_listing(spark):
    words = [f"w{k}" for k in range(90)]
    texts = [" ".join(words), " ".join(words[40:] + words[:40]), "a b " * 40, "x " * 30, "a b c d e f", "a b c d e", "a b", " a\tb\n", "", None, " \n", "é😀 " * 7 + " ".join(words)]
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, sketch string")
    got = {r.doc_id: r.sketch for r in fingerprints.fingerprint(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute_sketch(t), t
    near = docs.crossJoin(docs.select(F.col("text").alias("other")))
    near = fingerprints.fingerprint(fingerprints.fingerprint(near, "text", "a"), "other", "b").withColumn("near", fingerprints.likeness(F.col("a"), F.col("b")))
    for r in near.collect():
        a, b = brute_sketch(r.text), brute_sketch(r.other)
        want = sum(x == y for x, y in zip(a, b)) / fingerprints.SKETCHES if a and b else float(a == b)
        assert r.near == pytest.approx(want)


def test_sketch_keeps_order_and_counts(spark):
    words = [f"w{k}" for k in range(300)]
    a, b = " ".join(words), " ".join(words[150:] + words[:150])
    c = " ".join((words[:20]) * 8)
    rows = [(1, a), (2, b), (3, c), (4, " ".join(words[:20] * 2)), (5, ""), (6, None), (7, "  a \n b "), (8, "a b")]
    got = {r.i: r.sketch for r in fingerprints.fingerprint(spark.createDataFrame(rows, "i int, text string")).collect()}
    same = lambda x, y: sum(p == q for p, q in zip(got[x], got[y])) / fingerprints.SKETCHES
    assert 0 < same(1, 2) < 1 and same(3, 4) < 1 and got[5] == got[6] == [] and got[7] == got[8] and len(got[1]) == 64


def test_fingerprints_of_repeated_ids_and_no_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "x"), (None, "x"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, sketch string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((i or -1, len(t or "")) for i, t in rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op8_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_plan_meets_its_limits():
    sizes = {"a": 9000, "b": 500, "c": 500}
    p = mixing.plan(sizes, None, None, 2.0, False)
    assert max(p[s] / sizes[s] for s in sizes) == pytest.approx(2.0, abs=0.01)
    w = mixing.weights_at([0.9, 0.05, 0.05], 0.0)
    assert mixing.entropy(w) == pytest.approx(log(3))
    p = mixing.plan(sizes, 30_000, 0.8, None, False)
    total = sum(p.values())
    assert mixing.entropy([x / total for x in p.values()]) == pytest.approx(0.8 * log(3), abs=1e-3)
    assert all(v >= sizes[s] for s, v in mixing.plan(sizes, None, None, 2.0, True).items())


def test_mix_takes_whole_blocks_then_what_fits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 16)
    rows = [(k, "w " * (1 + k % 9), "big" if k % 3 else ("s1" if k % 2 else None), 7) for k in range(600)] + [(None, "a b", "s1", 7), (700, None, "empty", 7), (5, "w " * 6, "big", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place int")
    out = mixing.mix(docs, max_epochs=3.0)
    got = out.collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    given = mixing.plan(sizes, None, None, 3.0, False)
    h = {r.doc_id: r for r in docs.select("doc_id", *[F.shiftrightunsigned(F.xxhash64(F.lit(0), F.lit(e).cast("long"), F.col("doc_id")), 1).alias(f"h{e}") for e in range(4)]).collect()}
    for s, budget in given.items():
        full, rest = divmod(budget, sizes[s])
        mine = [(i, len((t or "").split())) for i, t, q, _ in rows if q == s]
        order = sorted(mine, key=lambda x: h[x[0]][f"h{full}"])
        want, run = [(e, i) for e in range(full) for i, _ in mine], 0
        k = 0
        while k < len(order):
            same = [x for x in order if x[0] == order[k][0]]
            if run + sum(n for _, n in same) > rest:
                break
            run += sum(n for _, n in same)
            want += [(full, i) for i, _ in same]
            k += len(same)
        key = lambda x: (x[0], -1 if x[1] is None else x[1])
        assert sorted(((r.epoch, r.doc_id) for r in got if r.source == s), key=key) == sorted(want, key=key)
    assert all(0 <= r.place <= 1 for r in got)
    assert mixing.mix(docs, max_epochs=2.0, keep_all=True).select("doc_id").distinct().count() == len({i for i, *_ in rows})
    assert mixing.mix(docs.limit(0), max_epochs=2.0).count() == 0


def test_licences_of_repeated_and_null_ids(spark):
    rows = [(None, "MIT License"), (None, None), (None, "apache license"), (1, "mit license"), (1, "mit license"), (1, "none")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.base_labels) for r in got) == [(0, 0, ""), (0, 1, "apache"), (0, 1, "mit"), (1, 0, ""), (1, 1, "mit"), (1, 1, "mit")]


def test_fingerprints_of_many_null_ids(spark, tmp_path):
    rows = [(None, f"a text without an id {k % 3} and a few more words") for k in range(40)] + [(3, "one of its own"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 42 and sum(r.doc_id is None for r in got) == 40
    assert len({r.fingerprint for r in got if r.doc_id is None}) == 3 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
