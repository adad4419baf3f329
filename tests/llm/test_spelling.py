import itertools
import random
import re
import zlib

import numpy as np
import pytest

from loomspark.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        form = min(others)[1] if others and -min(others)[0] >= 10 * n else None
        out[w] = [w, form, None, n, len(others), counts[form] if form else None]
    for w in out:
        r = w
        while out[r][1]:
            r = out[r][1]
        out[w][2] = r
    return sorted(map(tuple, out.values()), key=repr)


def brute_words(rows):
    counts = {}
    for doc_id, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{doc_id}:{r}".encode())
            if doc_id is not None and h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                counts[r] = counts.get(r, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_words_and_variants_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abéÿÀ÷") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    rows = [(d, " ".join(rng.choices(base, [k * k for k in range(1, 41)], k=60))) for d in range(120)]
    long = "ab" * 150
    rows += [(None, "Aaaaaaa aaaaaaaaaa,Aaaaaaab"), (None, "aaaaaaa"), (7, None), (8, ""), (8, ""), (200, (long + " ") * 30 + long[:7] + "é" + long[8:]), (201, long[:7] + "é" + long[8:] + " " + (long + "c ") * 2)]
    rows += [(300, "ÉcoleÉcole éco1école" * 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = spelling.words(docs)
    want = brute_words(rows)
    assert {r.word: r.n for r in counted.collect()} == want and len(want) > 40 and max(map(len, want)) > 200
    got = spelling.variants(counted).collect()
    assert sorted(map(tuple, got), key=repr) == brute_variants(want)
    assert any(r.form for r in got) and any(len(r.word) > 200 and r.form for r in got)


@pytest.mark.parametrize("bucket", [40, 500_000])
def test_near_words_of_few_letters(spark, monkeypatch, bucket):
    """Doubled letters, ties and words of one letter; keys over many and over few buckets."""
    monkeypatch.setattr(spelling, "PER_BUCKET", bucket)
    words = ["".join(w) for k in (1, 2, 3, 4, 5) for w in itertools.product("aé", repeat=k)] + ["aaab", "\U0001f600aa", "aa", "zaa"]
    counts = {w: 1 + (7 * k) % 3 for k, w in enumerate(words)}
    df = spark.createDataFrame([*counts.items(), (None, 5), ("", 6)], "word string, n long")
    want = {w: [o for o in counts if near(w, o)] for w in counts}
    want = {w: (len(o), *min((-counts[x], x) for x in o)) for w, o in want.items() if o}
    assert {r.word: (r.n_near, -r.best_n, r.best) for r in spelling.near_words(df).collect()} == want


def test_equal_keys_of_different_strings():
    raw = np.frombuffer(b"abxaby", np.uint8)
    a, m, none = np.array([0, 3, 0, 3, 1]), np.array([3, 3, 3, 3, 2]), np.zeros(5, np.int64)
    key = np.array([1, 1, 1, 1, 2], np.uint64)
    got = spelling._same(key, [(a, m), (none, none)], raw, lambda k: raw[a[k] : a[k] + m[k]].tobytes()).tolist()
    assert got[0] == got[2] != got[1] == got[3] and got[4] not in got[:4]


def test_empty_and_repeated_rows(spark):
    assert spelling.variants(spelling.words(spark.createDataFrame([], "doc_id long, text string, word int"))).count() == 0
    same = spark.createDataFrame([(1, "Longer words words1 longerx", 5)] * 3, "doc_id long, text string, n int")
    assert sorted(map(tuple, spelling.variants(spelling.words(same)).collect())) == sorted(brute_variants(brute_words([(1, "Longer words words1 longerx")] * 3)))


def test_roots_follow_all_forms(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w9" for w, _ in chain}
