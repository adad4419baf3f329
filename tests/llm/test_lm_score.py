import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import lm_score as lm

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, key int"


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^ \t-\r]+", text or "")] + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def made():
    rng = random.Random(5)
    names = [f"w{k}" for k in range(60)] + ["É", "a\xa0b", "."]
    rows = [(k, " ".join(rng.choices(names, range(len(names), 0, -1), k=rng.randint(0, 30))), None, 1) for k in range(90)]
    return rows + [(None, "w1 W2\tw3", "x", 1), (None, None, None, None), (7, None, None, 2), (8, "", None, 2), (9, " \n", None, 2), (11, "unseen unseen w1", None, 3), (11, "unseen unseen w1", None, 3), (500, "w1 " * 20_000, None, 4)]


@pytest.mark.parametrize("head", [1 << 17, 12])
def test_against_brute_force(spark, head):
    """Counts all broadcast, or most of them joined; both scores token by token."""
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = lm.train(df, short=6, most_listed=head)
    count = Counter(w for d, t, *_ in rows if not held(d) for w in split(t))
    n, v = sum(count.values()), len(count)
    lex = model.lexicon
    assert (lex.n, lex.v) == (n, v) and len(lex.c) <= head

    def slow(text):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(text))
        key, ending, bounds = lm.tokens(pa.array([text], pa.string()))
        rank = lex.rank_of(key)
        cls, slot, feature = lm._rows(lex, rank, ending, bounds)
        total = 0.0
        for k, w in enumerate(split(text)):
            for table, prior, at, target in ((model.classes, lex.classes, None, cls[k]), (model.words, lex.words[cls[k]] if slot[k] >= 0 else None, cls[k : k + 1], slot[k])):
                if prior is not None:
                    z = prior.astype(float) + sum(table[r].astype(float) for r in lm._places(feature[k : k + 1], at)[0])
                    total += math.log10(math.exp(z[target] - z.max()) / np.exp(z - z.max()).sum())
            if slot[k] < 0:
                total += math.log10((count[w] + 0.5) / lex.total[cls[k]])
        return base, total

    got = lm.score(df, model).collect()
    assert sorted(r.key or 0 for r in got) == sorted(r[3] or 0 for r in rows)
    kept = sorted(((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 2)) for r in got), key=repr)
    want = sorted(((d or -1, len(split(t)), sum(count[w] > 0 for w in split(t)), *map(float, slow(t))) for d, t, *_ in rows), key=repr)
    assert [x[:3] for x in kept] == [x[:3] for x in want]
    for a, b in zip(kept, want, strict=True):
        assert a[3] == pytest.approx(b[3], rel=1e-4, abs=1e-2) and a[4] == pytest.approx(b[4], rel=1e-3, abs=5e-2)
    # the words of an ending and its unseen word share all of its probability
    for k in range(lm.ENDINGS):
        mass = 0.5
        for w, c in count.items():
            key, ending, _ = lm.tokens(pa.array([w or ""], pa.string()))
            key, ending = (key[:1], ending[:1]) if w else (key[-1:], ending[-1:])
            rank = lex.rank_of(key)[0]
            if not 0 <= rank < lex.short and ending[0] == k:
                mass += c + 0.5
        assert mass == pytest.approx(lex.total[lm.CLASSES + k])


def test_better_than_shares_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lm.score(docs, lm.train(docs)).where(lm.held_out()).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.s - got.b) / got.n > 0.1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = lm.train(none)
    assert lm.score(none, model).count() == 0
    r = lm.score(spark.createDataFrame([(1, "a b", None, 1)], SCHEMA), model).first()
    assert r.n_tokens == 3 and r.n_known == r.train_tokens == 0 and r.base_score == pytest.approx(0) and r.score < 0
    full = lm.train(spark.createDataFrame([(1, None, None, 1), (2, "", None, 1)], SCHEMA))
    assert (full.lexicon.n, full.lexicon.v) == (2 - held(1) - held(2), 1)


def test_changes_are_averaged_in_a_tree():
    rng = np.random.default_rng(1)
    delta = rng.normal(size=(5, 4, 2)).astype(np.float16)
    met = rng.integers(0, 3, (5, 4)).astype(np.float32)

    def table(rows):
        return pa.table({"part": pa.array([3] * len(rows), pa.int32()), "worker": pa.array([r[0] for r in rows], pa.int32()), "delta": [r[1].tobytes() for r in rows], "met": [r[2].tobytes() for r in rows]})

    rows = [(k, delta[k], met[k]) for k in range(5)]
    halves = [lm._averaged(table(x)) for x in (rows[:3], rows[3:])]
    got = lm._averaged(pa.concat_tables(halves))
    want = (delta.astype(float) * met[..., None]).sum(0) / np.maximum(met.sum(0), 1)[:, None]
    assert np.allclose(np.frombuffer(got["delta"][0].as_py(), np.float16).reshape(4, 2), want, atol=5e-3)
    assert np.array_equal(np.frombuffer(got["met"][0].as_py(), np.float32), met.sum(0))
