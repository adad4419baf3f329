import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import collocations as co

SCHEMA = "doc_id long, lang string, text string, n int, word string"


def brute(rows, most=5, least=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, most + 1):
                f.update((lang, *w[i : i + size]) for i in range(len(w) - size + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang, *w] = (lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score)
    for (lang, *w), a in cand.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and a * 100 >= 100 * cand[lang, *w[i:j]]:
                    out.pop((lang, *w[i:j]), None)
    ranked = {}
    for row in sorted(out.values(), key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        ranked.setdefault(row[0], []).append(row)
    return sorted((lang, k + 1, *row[1:]) for lang, found in ranked.items() for k, row in enumerate(found))


def texts(seed, words=12, docs=80):
    rng = random.Random(seed)
    names = [*"abcdef", "en", "de", "é", "x" * 70, "W", "w\xa0v"][:words]
    out = []
    for _ in range(docs):
        w = rng.choices(names, [2.0**-k for k in range(len(names))], k=rng.randint(0, 40))
        out.append((rng.choice(["en", "de", None, "und"]), "".join(x + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for x in w)))
    return out + [("en", None), (None, ""), ("en", " . ,"), *[("de", "aa aa aa aa aa aa the line that stands everywhere")] * 9]


@pytest.mark.parametrize("listed", [1 << 19, 5, 0])
@pytest.mark.parametrize("most", [2, 5])
def test_against_brute_force(spark, monkeypatch, listed, most):
    """All words listed, some, and none; fragments added up over many small flushes."""
    monkeypatch.setattr(co, "HELD", 50)
    monkeypatch.setattr(co, "PER_BUCKET", 40)
    rows = texts(most)
    df = spark.createDataFrame([(k, *r, 1, "mine") for k, r in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(map(tuple, co.collocations(df, most=most, least=4, listed=listed).collect()))
    assert got == brute(rows, most, 4) and len(got) > 20


def test_top_and_empty(spark):
    rows = texts(9)
    df = spark.createDataFrame([(k, *r, 1, "mine") for k, r in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, co.collocations(df, least=4, top=3).collect()))
    assert got == [r for r in brute(rows, 5, 4) if r[1] <= 3]
    assert co.collocations(df.where("false")).count() == 0


def test_products_of_more_than_64_bits(spark):
    a, n, left, right = 3_000_000_000_017, 91_000_000_000_003, 5_000_000_000_029, 4_000_000_000_037
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(co._quotient("a", "n", "l", "r")).first()[0] == 1000 * a * n // (left * right)
    exact = spark.createDataFrame([(a, 6, 2 * a, 3)], "a long, n long, l long, r long")
    assert exact.select(co._quotient("a", "n", "l", "r")).first()[0] == 1000


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(co, "_row_hash", lambda rows: np.zeros(len(rows), np.uint64))
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6]], np.int32)
    got, n = co._added_up(rows, np.array([1, 1, 2, 1]), 2)
    assert got.tolist() == [[1, 2]] and n.tolist() == [3]
