"""Near-duplicate embeddings by lattice hashing.

Each table projects a unit vector at random to ``BLOCKS`` times 8 dimensions
and decodes each block to the nearest point of the E8 lattice; a cell is the
tuple of these points. A vector is filed under its own cell and looks into the
cells that have one of ``PROBES`` neighbouring points in one block. Cells
shrink as vectors grow in number, so that a vector meets about ``LOOK`` others
by chance in a table; there are as many tables as it takes to miss at most
``MISS`` of the pairs at the threshold, which is measured on drawn pairs.

Only ids and keys are filed; vectors go to the cells that hold anything to
compare. Vectors that meet are verified by their cosine in double precision. A
pair counts in the first table in which it meets, so links are counted without
listing pairs; edges are a spanning forest of each cell's links. Cells with
more than ``LIMIT`` members are dealt out as pairs of parts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark import runtime
from loomspark.llm import textbytes as tb
from loomspark.llm.components import components

COSINE = 0.93
BLOCKS, PROBES = 2, 4
LOOK, MISS = 16, 0.005
LIMIT = 2048


def decode_e8(x: np.ndarray, probes: int) -> np.ndarray:
    """The nearest E8 points of each row, times 2: the decoded one and neighbouring ones. (n, probes + 1, 8)"""
    found, far = [], []
    for shift in (0.0, 0.5):  # E8 is D8 and D8 moved by one half
        y = np.rint(x - shift)
        off = x - shift - y
        order = np.argsort(-np.abs(off), axis=1)[:, :3]
        step = np.where(off >= 0, 1, -1)
        odd = (y.sum(1).astype(np.int64) & 1).astype(bool)
        rows = np.arange(len(x))
        # An odd sum needs one coordinate rounded the other way, an even one none or two.
        for flips_odd, flips_even in (((0,), ()), ((1,), (0, 1)), ((2,), (0, 2))):
            z = y.copy()
            for flips, mask in ((flips_odd, odd), (flips_even, ~odd)):
                for f in flips:
                    c = order[mask, f]
                    z[rows[mask], c] += step[rows[mask], c]
            found.append(2 * (z + shift))
            far.append(((x - z - shift) ** 2).sum(1))
    near = np.argsort(np.stack(far, 1), axis=1, kind="stable")[:, : probes + 1]
    return np.take_along_axis(np.stack(found, 1), near[:, :, None], 1).astype(np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@lru_cache(1024)
def projection(dim: int, table: int, seed: int) -> np.ndarray:
    """Random orthogonal directions; a unit vector's image in a block has an expected length of 1."""
    wide = max(dim, 8 * BLOCKS)
    r = np.random.default_rng([seed, table, dim]).standard_normal((wide, 8 * BLOCKS))
    return np.linalg.qr(r)[0][:dim] * np.sqrt(wide / 8)


def cells(u: np.ndarray, label: np.ndarray, tables: range, probes: int, cell: float, seed: int) -> np.ndarray:
    """Hashes of the own cell and the probed ones in each of the tables: (n, tables, BLOCKS * probes + 1)."""
    dim = u.shape[1]
    out = np.zeros((len(u), len(tables), BLOCKS * probes + 1), np.uint64)
    for at, t in enumerate(tables):
        q = u @ projection(dim, t, seed) / cell
        h = tb.mix(label.astype(np.uint64) * np.uint64(4096) + np.uint64(t) + np.uint64(dim << 40))[:, None].repeat(out.shape[2], 1)
        for block in range(BLOCKS):
            p = decode_e8(q[:, 8 * block : 8 * block + 8], probes).view(np.uint64)
            # All keys hold the own point, but for those that probe in this block.
            p = np.concatenate([p[:, :1].repeat(1 + block * probes, 1), p[:, 1:], p[:, :1].repeat((BLOCKS - 1 - block) * probes, 1)], 1)
            for k in range(8):
                h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) ^ p[:, :, k])
        out[:, at] = h
    return out


def _meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do the rows of cells a and b meet? (own cell first)"""
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


def cell_size(n: int) -> float:
    """The width of cells in which a vector meets about ``LOOK`` of ``n`` by chance.

    Unrelated vectors meet at width 0.6 with a chance of 1.5e-5 (measured), which
    goes with the volume of a cell. Widths beyond 0.8 would tell nothing apart.
    """
    return min(0.8, 0.6 * (LOOK / (1.5e-5 * max(n, 1))) ** (1 / (8 * BLOCKS)))


def table_count(cosine: float, dim: int, cell: float, probes: int, seed: int, draws: int = 2000, tries: int = 4) -> int:
    """How many tables miss at most ``MISS`` of the pairs at the cosine; from drawn pairs."""
    r = np.random.default_rng(seed)
    a, z = unit(r.standard_normal((draws, dim))), r.standard_normal((draws, dim))
    z = z - (z * a).sum(1, keepdims=True) * a
    b = unit(cosine * a + np.sqrt(max(0.0, 1 - cosine**2)) * unit(z)) if dim > 1 else a
    x, y = (cells(v, np.zeros(draws, np.int64), range(tries), probes, cell, seed) for v in (a, b))
    met = np.mean([_meets(x[:, t], y[:, t]).mean() for t in range(tries)])
    return max(2, int(np.ceil(np.log(MISS) / np.log1p(-np.clip(met, 1e-3, 1 - 1e-6)))))


def _pairs_within(u, own, side, split, cosine):
    """Index pairs (i < j) to compare whose cosine may reach the threshold, in steps of bounded memory."""
    n = len(u)
    for at in range(0, n, 512):
        s = u[at : at + 512] @ u.T
        i, j = np.nonzero(s >= cosine - 1e-6)
        i = i + at
        keep = (i < j) & (own[i] | own[j])
        if split:
            keep &= side[i] != side[j]
        yield i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index."""
    root = np.arange(n)
    while True:
        m = root.copy()
        np.minimum.at(m, i, root[j])
        np.minimum.at(m, j, root[i])
        m = m[m]
        if (m == root).all():
            return root
        root = m


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int | None = None, probes: int = PROBES, cell: float | None = None, limit: int = LIMIT, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Vectors are compared when their labels are equal and not null and they have
    as many components. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing. Rows of
    one id count as vectors of their own in ``n_links``; groups of equal vectors
    with one smallest id share their component. The search finds a pair in one
    table or another with high probability; no pair below the cosine is linked. ``cell`` and ``tables`` follow from the
    number of vectors and the cosine where they aren't given.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = runtime.stored(rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = runtime.stored(classes.withColumn("hash", F.xxhash64("label", "v")))  # with the id it names a class
    most = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).agg(F.max("n"), F.max("dim")).first()
    cell = cell or cell_size(most[0] or 0)
    tables = tables or table_count(cosine, most[1] or 64, cell, probes, seed)
    per = tables * (BLOCKS * probes + 1)

    def opened(batch):
        for n in np.unique(np.array(pa.compute.list_value_length(batch.column("v")))).tolist() if batch.num_rows else ():
            b = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("v")), n))
            yield b, np.array(b.column("v").flatten() if isinstance(b.column("v"), pa.Array) else b.column("v").combine_chunks().flatten()).reshape(-1, n)

    def file(batches, full):
        own = np.arange(per) % (BLOCKS * probes + 1) == 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                for b, v in opened(whole.slice(at, 512)):
                    h = cells(unit(v), np.array(b.column("label")), range(tables), probes, cell, seed)
                    cols = [pa.array(h.reshape(-1).view(np.int64)), pa.array(np.tile(own, len(v)))]
                    if full:
                        take = pa.array(np.repeat(np.arange(len(v)), per))
                        t = np.repeat(np.arange(tables), BLOCKS * probes + 1)
                        cols += [pa.array(np.tile(t, len(v)).astype(np.int64)), *(b.column(c).take(take) for c in ("id", "hash"))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "own", "t", "id", "hash"][: len(cols)])

    # A cell is of use if two meet in it and it is one's own.
    n = F.count("*")
    live = classes.select("label", "v").mapInArrow(lambda b: file(b, False), "key long, own boolean").groupBy("key").agg(n.alias("n"), F.max("own").alias("own"))
    live = runtime.stored(live.where("own and n > 1").select("key", "n", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    filed = classes.select("label", "v", "id", "hash").mapInArrow(lambda b: file(b, True), "key long, own boolean, t long, id long, hash long").join(live.select("key", "parts"), "key")
    filed = filed.withColumn("side", F.pmod(F.xxhash64("id", "hash"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("side", "other"), F.greatest("side", "other")
    filed = filed.select("key", "own", "t", "id", "hash", "side", lo.alias("lo"), hi.alias("hi")).join(classes, ["id", "hash"])
    shipped = live.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    buckets = max(8 * runtime.partitions(spark), -(-shipped // limit))  # about as many rows in a bucket as a cell may hold
    filed = filed.withColumn("bucket", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(buckets)))

    def compare(key, table):
        ids, hashes, links, ea, ha, eb = [], [], [], [], [], []
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("id", "ascending"), ("hash", "ascending"), ("own", "descending")])
        k, lo, hi, t = (np.array(table[c]) for c in ("key", "lo", "hi", "t"))
        own, side, me, which, copies, label = (np.array(table[c]) for c in ("own", "side", "id", "hash", "copies", "label"))
        at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        size = pa.compute.list_value_length(table["v"]).to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy()
        start = np.cumsum(size) - size
        for p, q in zip(at.tolist(), [*at[1:].tolist(), len(k)], strict=True):
            if q - p < 2 or not own[p:q].any():
                continue
            u = unit(flat[start[p] : start[p] + size[p] * (q - p)].reshape(q - p, -1))
            found = [x for x in _pairs_within(u, own[p:q], side[p:q], lo[p] != hi[p], cosine) if len(x[0])]
            if not found:
                continue
            i, j = (np.concatenate([x[y] for x in found]) for y in (0, 1))
            exact = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
            i, j = i[exact], j[exact]
            used = np.unique(np.concatenate([i, j]))
            if not len(used):
                continue
            root = used[_forest(len(used), np.searchsorted(used, i), np.searchsorted(used, j))]
            ea.append(me[p:q][used])
            ha.append(which[p:q][used])
            eb.append(me[p:q][root])
            # Count a pair in its first table, and there in one cell.
            now = int(t[p])
            c = np.zeros((q - p, now + 1, BLOCKS * probes + 1), np.uint64)
            c[used] = cells(u[used], label[p:q][used], range(now + 1), probes, cell, seed)
            first = np.ones(len(i), bool)
            for x in range(now):
                first &= ~_meets(c[i, x], c[j, x])
            here = np.uint64(int(k[p]) & (1 << 64) - 1)
            a, b = c[i, now], c[j, now]
            both = (a[:, :1] == b).any(1) & (b[:, :1] == a).any(1)
            first &= ~both | (here == np.minimum(a[:, 0], b[:, 0]))
            count = np.zeros(q - p, np.int64)
            np.add.at(count, i[first], copies[p:q][j[first]])
            np.add.at(count, j[first], copies[p:q][i[first]])
            ids.append(me[p:q][count > 0])
            hashes.append(which[p:q][count > 0])
            links.append(count[count > 0])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        a, h, n, x, hx, y = map(join, (ids, hashes, links, ea, ha, eb))
        edge = x != y
        x, hx, y = x[edge], hx[edge], y[edge]
        return pa.table({"id": np.concatenate([a, x]), "hash": np.concatenate([h, hx]), "links": np.concatenate([n, np.zeros(len(x), np.int64)]), "to": np.concatenate([a, y])})

    found = runtime.stored(filed.repartition(runtime.partitions(spark), "bucket").groupBy("bucket").applyInArrow(compare, "id long, hash long, links long, to long"))
    runtime.discard(live)
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id", "hash").agg(F.sum("links").alias("links"))
    known = classes.join(links, ["id", "hash"], "left").join(comp, "id", "left").select("label", "v", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "id").alias("component"))
    linked = rows.where("ok").join(known, ["label", "v"]).select("vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE array_cosine_similarity(a.e, b.e) >= 0.93
), r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a
), m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN m ON e.vec_id = m.id
"""
