import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import ngram_join as nj
from loomspark.llm import textbytes as tb


def brute(docs, k, part, whole):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in docs:
        w = low(t).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    docs = []
    for g in range(25):
        base = [f"w{r.randint(0, 900)}" for _ in range(r.choice([3, 5, 9, 20, 60, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 2)] = [f"x{r.randint(0, 900)}"] * r.randint(0, 2)
            docs.append((len(docs) * 3 + 1, (" " if r.random() < 0.5 else "\n\t").join(x.upper() if r.random() < 0.1 else x for x in w)))
    docs += [(2, ""), (5, None), (8, docs[0][1]), (11, docs[30][1])]
    return docs


@pytest.mark.parametrize("seed,k,part,whole", [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_same_as_all_pairs(spark, seed, k, part, whole):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_documents(df, k=k, part=part, whole=whole).collect()}
    assert got == brute(docs, k, part, whole)


@pytest.mark.parametrize("part,whole", [(85, 100), (80, 100), (3, 4)])
def test_similar_sets_agree_in_a_subset_of_one_part(part, whole):
    r = np.random.default_rng(3)
    t = nj.Threshold(part, whole)
    plans = nj.plans_of(t, 2000)
    for n in [2, 3, 4, 5, 7, 8, 10, 13, 20, 34, 55, 120, 300, 900] * 12:
        a = r.integers(0, 2**64, n, dtype=np.uint64)
        drop = r.integers(0, t.most_apart(2 * n) + 1)
        gone = r.integers(0, min(drop, n - 1) + 1)
        b = np.concatenate([a[gone:], r.integers(0, 2**64, drop - gone, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if whole * both < part * (len(a) + len(b) - both) or set(a) == set(b):
            continue
        g, d = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
        keys, who, parts = nj.keys_of(g, d, plans, t)
        same = np.isin(keys, np.intersect1d(keys[who == 0], keys[who == 1])) & (who == 0)
        where, count = np.unique(parts[same], return_counts=True)
        assert any(c >= plans[int(x) >> 32].subset for x, c in zip(where, count)), (n, drop)


def test_unrelated_sets_share_no_key_and_send_few():
    r = np.random.default_rng(4)
    t = nj.Threshold(80, 100)
    plans = nj.plans_of(t, 2000)
    for n in (6, 12, 40, 300, 1000):
        g, d = np.sort(r.integers(0, 2**64, (500, n), dtype=np.uint64), axis=1).ravel(), np.repeat(np.arange(500), n)
        keys, who, _ = nj.keys_of(g, d, plans, t)
        sent = np.unique(np.stack([keys, who.astype(np.uint64)]), axis=1)[0]
        assert len(np.unique(sent)) == len(sent)
        assert len(keys) / 500 < 1.2 * n + 12


def test_common_keys_go_by_rare_shingles(spark, monkeypatch):
    """Many documents around one passage, none alike but for some pairs, with keys of over two documents taken as common."""
    monkeypatch.setattr(nj, "FEW", 2)
    r = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for k in range(120):
        own = [f"o{k}_{j}" for j in range(r.choice([8, 30, 60]))]
        docs.append((k, " ".join(passage[: r.choice([20, 60])] + own)))
        if k % 4 == 0:
            docs.append((1000 + k, " ".join([*passage[:59], "x", *own])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_documents(df, k=5, part=80).collect()}
    assert got == brute(docs, 5, 80, 100)


def test_too_low_a_threshold_is_an_error():
    with pytest.raises(ValueError, match="too low"):
        nj.plans_of(nj.Threshold(1, 2), 100)


@pytest.mark.parametrize("part,whole", [(3, 4)])
def test_lower_thresholds_reach_over_bands(spark, part, whole):
    docs = [(k, " ".join(f"w{j}" for j in range(n + 3))) for k, n in enumerate([10, 13, 16, 20, 31, 40, 90])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_documents(df, k=4, part=part, whole=whole).collect()}
    assert got == brute(docs, 4, part, whole)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "q r s t"), (9, "Q R S T"), (None, "only null here now"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in nj.similar_documents(df).collect()), key=str)
    assert (9, 4) in got and (7, 7) in got and (-1, 4) in got and len(got) == 6
    assert nj.similar_documents(df.limit(0)).count() == 0


def test_parity_counts_at_most_the_difference():
    g, d = nj.shingles(*tb.utf8(pa.array(["a b c d e f g h", "a b c d e f g x"])), 4)
    s = nj.parity(g, d, 2)
    assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= 2


@pytest.mark.parametrize("seed", [4, 5])
def test_templates_with_own_parts_of_all_sizes(spark, monkeypatch, seed):
    """Documents of one template, of which some are similar; all their keys count as common ones."""
    monkeypatch.setattr(nj, "FEW", 2)
    r = random.Random(seed)
    template = [f"t{k}" for k in range(120)]
    docs = []
    for g in range(40):
        own = [f"o{r.randint(0, 10**6)}" for _ in range(r.choice([0, 3, 6, 9, 12, 15, 18, 25, 40]))]
        for _ in range(r.choice([1, 1, 2, 3])):
            w = own if r.random() < 0.6 else [*own[:-2], f"n{r.random()}"]
            at = r.choice([0, 60, 120])
            docs.append((len(docs), " ".join(template[:at] + w + template[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nj.similar_documents(df).collect()}
    want = brute(docs, 4, 85, 100)
    assert got == want and 5 < len({c for _, c in want.values()}) < len(docs)


def test_no_pairs_of_documents_that_share_a_template_alone(spark, monkeypatch):
    """Twice as many such documents make no pair to compare, and neither do large groups of copies among them."""
    sent = []
    monkeypatch.setattr(nj, "FEW", 256)
    plain = nj._verify
    monkeypatch.setattr(nj, "_verify", lambda pairs, *rest: sent.append(pairs.count()) or plain(pairs, *rest))
    template = " ".join(f"t{k}" for k in range(250))
    for n in (400, 800):
        sent.clear()
        docs = [(k, template + " " + " ".join(f"o{k}x{j}" for j in range(60))) for k in range(n)] + [(n + k, template + f" end{k}") for k in range(n)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {x.doc_id: x.component_id for x in nj.similar_documents(df).collect()}
        assert got == {k: min(k, n) for k in range(2 * n)}
        assert sent[0] < 2 * n * 60 and sent[1] == 0
