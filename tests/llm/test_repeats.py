import hashlib
import random

import pytest

from loomspark.llm.repeats import Units, remove_repeats
from loomspark.llm.substring_dedup import fm_engine, remove_repeated_passages
from loomspark.llm.suffix_dedup import radix_engine, remove_repeated_bytes

SCHEMA = "doc_id long, text string, n_units int, extra string"


def brute(docs, units, width, join):
    """{(id, text): (kept, spans)} by listing every window."""
    first = {}
    cut = [(i if i is not None else float("inf"), units(t or "")) for i, t in docs]
    for i, u in cut:
        for p in range(len(u) - width + 1):
            w = tuple(u[p : p + width])
            first[w] = min(first.get(w, float("inf")), i)
    out = []
    for i, u in cut:
        gone = [False] * len(u)
        for p in range(len(u) - width + 1):
            if first[tuple(u[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, join([x for x, g in zip(u, gone) if not g])))
    return out


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 30, 60)]
    docs = []
    for k in range(150):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
            w += r.choice(passages)
        docs.append((k, ("\n" if k % 3 else " \t ").join(w)))
    docs += [(200, docs[7][1]), (201, docs[7][1]), (7, docs[7][1]), (202, None), (203, ""), (None, docs[9][1]), (204, "é" * 70), (205, "xx" + "é" * 60), (3, "a b " * 50), (206, "a b " * 20)]
    return docs


@pytest.mark.parametrize("hot", [None, (1, 10**6), (1, 2)])
@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_same_as_every_window_listed(spark, kind, hot):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)
    if kind == "words":
        got = remove_repeated_passages(df) if hot is None else remove_repeats(df, Units(True, 13, 7, 4000, *hot), fm_engine, "doc_id", "text")
        want = brute(docs, lambda t: t.split(), 13, " ".join)
    else:
        got = remove_repeated_bytes(df) if hot is None else remove_repeats(df, Units(False, 50, 20, 4000, *hot), radix_engine, "doc_id", "text")
        want = brute(docs, lambda t: t.encode(), 50, bytes)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_units, r.n_removed, len(r.spans), hashlib.md5(r.kept.encode() if kind == "words" else bytes(r.kept)).hexdigest(), r.extra) for r in got.collect())
    want = sorted((i if i is not None else -1, a, b, c, hashlib.md5(k.encode() if kind == "words" else k).hexdigest(), "x") for (i, _), (a, b, c, k) in zip(docs, want))
    assert rows == want


def test_empty_table(spark):
    assert remove_repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
