import numpy as np
import pytest

from loomspark.llm import embedding_dedup as ed


def brute(rows):
    ok = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(ok))}
    for a in range(len(ok)):
        for b in range(len(ok)):
            x, y = ok[a], ok[b]
            if a != b and x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93:
                links[a].append(b)
    out = []
    for a in range(len(ok)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((ok[a][0], len(links[a]), min(ok[b][0] for b in seen)))
    return sorted(out)


@pytest.mark.parametrize("limit", [2048, 40])
def test_same_as_all_pairs(spark, limit):
    r = np.random.default_rng(1)
    rows = []
    for g in range(40):
        base = r.standard_normal(64)
        for _ in range([1, 2, 8, 90][g % 4]):
            rows.append((len(rows) * 2, [float(x) for x in (base + 0.15 * r.standard_normal(64)).astype(np.float32)], g % 3))
    rows += [(10**6, rows[5][1], rows[5][2]), (10**6 + 1, rows[5][1], 9), (10**6 + 2, [2 * x for x in rows[5][1]], rows[5][2])]
    odd = [(10**7, None, 1), (10**7 + 1, [0.0] * 64, 1), (10**7 + 2, [None] * 64, 1), (10**7 + 3, [float("nan")] + [1.0] * 63, 1), (10**7 + 4, rows[0][1], None), (10**7 + 5, [], 1), (10**7 + 6, [1.0, 2.0], 1), (10**7 + 7, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in ed.near_duplicates(df, limit=limit).collect()}
    assert len(got) == len(rows) + len(odd)
    want = brute(rows)
    assert sum(got[i].n_links for i, *_ in want) >= 0.98 * sum(n for _, n, _ in want)
    assert all(got[i].n_links <= n for i, n, _ in want)
    assert np.mean([got[i].component_id == c for i, _, c in want]) > 0.98
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, *_ in odd)
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_decoded_point_is_the_nearest():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 8)) * 2
    near = ed.decode_e8(x, 4) / 2
    best = ((x - near[:, 0]) ** 2).sum(1)
    assert best.max() <= 1 + 1e-9  # the lattice's covering radius
    for k in range(5):
        z = near[:, k]
        whole = (z == np.rint(z)).all(1) | (z - 0.5 == np.rint(z - 0.5)).all(1)
        assert whole.all() and (z.sum(1) % 2 == 0).all() and (((x - z) ** 2).sum(1) >= best - 1e-9).all()


def pairs_at(cosine, n, seed, dim=64):
    r = np.random.default_rng(seed)
    a, z = ed.unit(r.standard_normal((n, dim))), r.standard_normal((n, dim))
    return a, cosine * a + np.sqrt(1 - cosine**2) * ed.unit(z - (z * a).sum(1, keepdims=True) * a)


def test_recall_at_the_threshold(spark):
    rows = []
    for k, cosine in enumerate((0.9301, 0.935, 0.95)):
        for a, b in zip(*pairs_at(cosine, 300, k), strict=True):
            rows += [(len(rows), a.tolist(), 0), (len(rows) + 1, b.tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x for x in ed.near_duplicates(df).collect()}
    assert np.mean([got[i].n_links == 1 and got[i].component_id == i - i % 2 for i in got]) >= 0.98
    below = {x.vec_id: x for x in ed.near_duplicates(df, cosine=0.94).collect()}
    assert not any(below[i].n_links for i in range(1200)) and np.mean([below[i].n_links for i in range(1200, 1800)]) >= 0.98


@pytest.mark.parametrize("n", [100, 10**5, 10**7, 10**9])
def test_recall_and_chance_at_every_size(n):
    cell = ed.cell_size(n)
    tables = ed.table_count(0.93, 64, cell, ed.PROBES, 7)
    x, y = (ed.cells(v, np.zeros(1000, int), range(tables), ed.PROBES, cell, 7) for v in pairs_at(0.93, 1000, 3))
    met = np.array([ed._meets(x[:, t], y[:, t]) for t in range(tables)])
    assert met.any(0).mean() >= 0.98
    chance = np.mean([ed._meets(x[:, t], np.roll(x[:, t], k, 0)).mean() for t in range(4) for k in range(1, 200)])
    assert chance * n <= max(4 * ed.LOOK, 0.002 * n if n <= 10**4 else n / 10**5)


def test_repeated_ids_and_clashing_names(spark):
    a, b = ([float(x) for x in v[0]] for v in pairs_at(0.5, 1, 9))
    names = "vec_id long, embedding array<double>, label int, key long, v string, copies int, id long, hash int, n_links string"
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (3, b, 0), (None, a, 0)]
    df = spark.createDataFrame([(*r, None, "x", 5, 7, 8, "y") for r in rows], names)
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in ed.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (None, 0, None, True)], key=str)
