"""Training a head of several soft labels on frozen vectors.

Mini-batches that fill a part or more are spread over tasks, which sum up their
gradients; of smaller ones, whose steps no second task could speed up, a task
does a bounded span one after another.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.functions.permute import permuted
from loomspark.functions.scalars import learning_rate_at
from loomspark.operators.corpus import running_sum
from loomspark.sources import versions

FAN = 32  # partial sums that are added at a time
PER_PART = 64 << 20  # bytes of vectors in a part of a batch
SPAN = 256  # steps that one task does at most, if their batches and weights fit a part
SUMS = "worker int, n long, loss binary, error binary, grad binary"
STEPS = "step long, loss double, norm double, w binary, m binary, v binary"


@dataclass
class Settings:
    batch: int = 1024
    epochs: int = 4
    rate: float = 1e-3
    weight_decay: float = 0.01
    warmup: float = 0.05
    decay: float = 0.2
    clip: float = 1.0
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    log_every: int = 10
    val_every: int = 50
    seed: int = 0


@dataclass
class Head:
    """Weights (targets x dimensions) after the last step and at the smallest validation loss."""

    targets: list[str]
    weights: np.ndarray
    best: np.ndarray
    best_step: int | None = None
    best_loss: float = inf
    best_mae: float | None = None
    events: list[dict] = field(default_factory=list)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = np.array(column.flatten(), np.float64)
    if len(values) != len(column) * width:
        raise ValueError(f"vectors and targets must have one size each; {width} expected")
    return values.reshape(-1, width)


def _losses(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(summed loss, summed absolute error, error) of vectors and their targets."""
    z = x @ w.T
    e = np.exp(-np.abs(z))
    off = np.where(z >= 0, 1, e) / (1 + e) - y
    return float((np.maximum(z, 0) - z * y + np.log1p(e)).sum()), float(np.abs(off).sum()), off


def _sums(rows: DataFrame, heads: list[np.ndarray], gradient: bool) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, summed loss and summed absolute error of each head, summed gradient of the first) over all elements of (vector, targets) rows.

    Tasks work on whole Arrow batches; their sums are added ``FAN`` at a time
    until one step is left for the driver.
    """
    sent = rows.sparkSession.sparkContext.broadcast(heads)  # each targets x dimensions
    shape = heads[0].shape

    def run(batches):
        n, loss, error, grad = 0, np.zeros(len(sent.value)), np.zeros(len(sent.value)), np.zeros(shape)
        for b in batches:
            x, y = _matrix(b.column(0), shape[1]), _matrix(b.column(1), shape[0])
            n += len(x)
            for k, w in enumerate(sent.value):
                one, other, off = _losses(w, x, y)
                loss[k] += one
                error[k] += other
                if gradient and k == 0:
                    grad += off.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([loss.tobytes()]), pa.array([error.tobytes()]), pa.array([grad.tobytes() if gradient else b""])], ["worker", "n", "loss", "error", "grad"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("worker")
        total = [np.sum([np.frombuffer(g) for g in t[c].to_pylist()], 0).tobytes() for c in ("loss", "error", "grad")]
        return pa.table({"worker": pa.array([t["worker"][0].as_py() // FAN], pa.int32()), "n": [sum(t["n"].to_pylist())]} | {c: [x] for c, x in zip(("loss", "error", "grad"), total, strict=True)})

    sums, workers = rows.select("vector", "targets").mapInArrow(run, SUMS), rows.rdd.getNumPartitions()
    while workers > FAN:
        sums = sums.groupBy(F.call_function("div", F.col("worker"), F.lit(FAN))).applyInArrow(add, SUMS)
        workers = -(-workers // FAN)
    got = sorted(sums.collect(), key=lambda r: r.worker)  # at most FAN rows
    sent.destroy()
    loss, error = (np.sum([np.zeros(len(heads)), *(np.frombuffer(r[c]) for r in got)], 0) for c in ("loss", "error"))
    grad = np.sum([np.frombuffer(r.grad) for r in got], 0).reshape(shape) if gradient and got else np.zeros(shape)
    return sum(r.n for r in got), loss, error, grad


def _moved(w: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, step: int, total: int, s: Settings) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The gradient's norm, and weights and moments after the step behind ``step`` others."""
    norm = float(np.sqrt((grad * grad).sum()))
    if norm > s.clip:
        grad = grad * (s.clip / (norm + 1e-6))
    rate = s.rate * learning_rate_at(step, total, s.warmup, s.decay)
    m = s.betas[0] * m + (1 - s.betas[0]) * grad
    v = s.betas[1] * v + (1 - s.betas[1]) * grad * grad
    w = w * (1 - rate * s.weight_decay)
    w = w - rate * (m / (1 - s.betas[0] ** (step + 1))) / (np.sqrt(v / (1 - s.betas[1] ** (step + 1))) + s.eps)
    return norm, w, m, v


def _span(rows: DataFrame, w: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, steps: int, total: int, s: Settings) -> list:
    """``STEPS`` of as many steps, done in one task on (place, vector, targets) rows in order of place.

    Weights are given where the head is to be validated and after the last step, moments there.
    """
    sent = rows.sparkSession.sparkContext.broadcast((w, m, v))
    shape = w.shape

    def run(batches):
        (w, m, v), done, held, number = sent.value, step, [], None

        def close():
            nonlocal w, m, v, done, held
            x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            loss, _, off = _losses(w, x, y)
            norm, w, m, v = _moved(w, m, v, off.T @ x / y.size, done, total, s)
            done, held = done + 1, []
            last = done == step + steps
            out = [w if last or done % s.val_every == 0 else None, *((m, v) if last else (None, None))]
            return pa.RecordBatch.from_arrays([pa.array([done]), pa.array([loss / y.size]), pa.array([norm]), *(pa.array([None if a is None else a.tobytes()], pa.binary()) for a in out)], ["step", "loss", "norm", "w", "m", "v"])

        for b in batches:
            at = np.array(b.column(0)) // s.batch
            x, y = _matrix(b.column(1), shape[1]), _matrix(b.column(2), shape[0])
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for i, j in zip(cuts, cuts[1:]):  # noqa: B905
                if held and at[i] != number:
                    yield close()
                number = at[i]
                held.append((x[i:j], y[i:j]))
        if held:
            yield close()

    got = sorted(rows.coalesce(1).sortWithinPartitions("place").select("place", "vector", "targets").mapInArrow(run, STEPS).collect(), key=lambda r: r.step)  # at most SPAN rows
    sent.destroy()
    return got


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vector").isNotNull() & F.col("targets").isNotNull() & ~F.exists("targets", lambda t: t.isNull()) & ~F.exists("vector", lambda v: v.isNull()))


def fit_head(train: DataFrame, validation: DataFrame, targets: list[str], settings: Settings = Settings(), log=None) -> Head:
    """A linear head without a bias, from zero, by AdamW on the binary cross-entropy of all targets.

    Rows are (row_id, vector, targets): a long that no two training rows share,
    an array of numbers and one of a soft label of 0 to 1 for each target. Rows
    where one of them or a part is null are left out. Each epoch lays the rows
    out in a seeded order once, so a job reads its own batches alone; the
    gradient's norm is clipped, and the rate follows warm-up, plateau and cosine
    tail. The validation rows are stored once and scored every ``val_every``
    steps and at the end, the heads of a job together; the weights of the
    earliest smallest loss are the best ones. ``log`` (such as
    ``sources.runlog.Log``) gets the events of each job behind it.
    """
    s, spark = settings, train.sparkSession
    train = _usable(train).withColumn("__one", F.lit(1).cast("long"))
    train = runtime.stored(running_sum(train.select("row_id", "vector", "targets", "__one"), "__one").select((F.col("cum") - 1).alias("position"), "vector", "targets"))
    n = train.count()
    first = train.select(F.size("vector").alias("d")).first()
    if not n:
        raise ValueError("no training rows")
    validation = runtime.stored(_usable(validation).select("vector", "targets"))
    w = np.zeros((len(targets), first.d))
    m, v = np.zeros_like(w), np.zeros_like(w)
    per_epoch = -(-n // s.batch)
    total, step, began = per_epoch * s.epochs, 0, time.monotonic()
    head = Head(targets, w, w.copy())
    losses: list[float] = []
    size = s.batch * (first.d + len(targets)) * 8
    parts = max(1, size // PER_PART)
    span = max(1, min(SPAN, PER_PART // max(size, w.nbytes)))

    def tell(event: dict) -> None:
        elapsed = time.monotonic() - began
        event |= {"elapsed_seconds": elapsed, "eta_seconds": elapsed * (total - step) / max(1, step)}
        head.events.append(event)
        if log is not None:
            log.add(event)

    for epoch in range(1, s.epochs + 1):
        place = permuted(F.col("position"), n, s.seed + epoch)
        laid = train.withColumn("place", place).withColumn("span", F.call_function("div", "place", F.lit(s.batch * span).cast("long"))).withColumn("part", F.col("place") % parts)
        home = runtime.new_path(spark)
        laid.repartition("span", "part").sortWithinPartitions("span", "place").select("place", "vector", "targets", "span").write.partitionBy("span").parquet(home)
        schema = laid.select("place", "vector", "targets").schema
        for k in range(0, per_epoch, span):
            rows, steps = spark.read.schema(schema).parquet(f"{home}/span={k // span}"), min(span, per_epoch - k)
            if parts > 1:
                count, loss, _, grad = _sums(rows, [w], True)
                norm, w, m, v = _moved(w, m, v, grad / (count * len(targets)), step, total, s)
                made = [(step + 1, float(loss[0]) / (count * len(targets)), norm, w)]
            else:
                got = _span(rows, w, m, v, step, steps, total, s)
                w, m, v = (np.frombuffer(x).reshape(w.shape) for x in got[-1][3:])
                made = [(r.step, r.loss, r.norm, r.w and np.frombuffer(r.w).reshape(w.shape)) for r in got]
            step += steps
            tried = {at: x for at, _, _, x in made if at % s.val_every == 0 or at == total}
            scored, loss, error, _ = _sums(validation, list(tried.values()), False) if tried else (0, [], [], None)
            found = dict(zip(tried, zip(loss, error, strict=True), strict=True))
            for at, trained, norm, x in made:
                losses.append(trained)
                if at % s.log_every == 0:
                    after = s.rate * learning_rate_at(at, total, s.warmup, s.decay)
                    tell({"event": "train", "step": at, "epoch": epoch, "loss": float(np.mean(losses)), "grad_norm": norm, "learning_rate": after})
                    losses = []
                if at in found and scored:
                    smaller, mae = (float(c) / (scored * len(targets)) for c in found[at])
                    tell({"event": "validation", "step": at, "epoch": epoch, "loss": smaller, "mae": mae})
                    if smaller < head.best_loss:
                        head.best, head.best_step, head.best_loss, head.best_mae = x.copy(), at, smaller, mae
            if log is not None:
                log.flush()
        runtime.delete(spark, home)
    head.weights = w.copy()
    if head.best_step is None:  # nothing to validate on
        head.best, head.best_step = w.copy(), step
    runtime.discard(train, validation)
    return head


def save_head(spark: SparkSession, head: Head, path: str) -> str:
    """Keep the best weights as a versioned table (target, dimension, weight) with the step and its measures as its state."""
    rows = [(t, d, float(x)) for t, line in zip(head.targets, head.best, strict=True) for d, x in enumerate(line)]
    state = {"targets": head.targets, "step": head.best_step, "loss": None if head.best_loss == inf else head.best_loss, "mae": head.best_mae}
    return versions.commit(spark.createDataFrame(rows, "target string, dimension int, weight double"), path, versions.version(spark, path), state=state)


def load_head(spark: SparkSession, path: str) -> Head:
    """The head kept at ``path``; fails unless every target has every dimension once."""
    state = versions.state(spark, path)
    rows = versions.read(spark, path).collect()  # targets x dimensions
    width = max((r.dimension for r in rows), default=-1) + 1
    w = np.full((len(state["targets"]), width), np.nan)
    for r in rows:
        w[state["targets"].index(r.target), r.dimension] = r.weight
    if not w.size or np.isnan(w).any() or len(rows) != w.size:
        raise ValueError(f"the head at {path} isn't whole")
    return Head(state["targets"], w, w.copy(), state["step"], inf if state["loss"] is None else state["loss"], state["mae"])


def predict(rows: DataFrame, head: Head) -> DataFrame:
    """(row_id, probs): probabilities of the head's best weights, of single precision; null vectors have none."""
    w = np.ascontiguousarray(head.best)
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), w.shape[1])
            p = np.exp(-np.logaddexp(0, -(x @ sent.value.T))).astype(np.float32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["row_id", "probs"])

    return rows.where(F.col("vector").isNotNull()).select(F.col("row_id").cast("long"), "vector").mapInArrow(run, "row_id long, probs array<float>")
