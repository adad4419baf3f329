from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as X
from loomspark.functions.permute import permuted
from loomspark.operators import training
from loomspark.plans import registry
from loomspark.sources import runlog, versions

TARGETS = ["f::a", "f::b", "g::a"]


def made(n, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = 1 / (1 + np.exp(-x @ rng.normal(size=(5, 3)) * 2))
    return x, y


def frame(spark, x, y, step=3):
    return spark.createDataFrame([(k * step, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, vector array<double>, targets array<double>")


def by_numpy(order, x, y, vx, vy, s):
    """The same run with all rows at hand; ``order`` are the places of each epoch."""

    def loss(w, x, y):
        z = x @ w.T
        return float(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-abs(z))))), float(np.mean(abs(1 / (1 + np.exp(-z)) - y)))

    w = np.zeros((y.shape[1], x.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    per, out, step, best = -(-len(x) // s.batch), [], 0, (float("inf"), None, None)
    total = per * s.epochs
    warm, tail = max(1, round(s.warmup * total)), max(1, round(s.decay * total))
    for places in order:
        for k in range(per):
            at = np.flatnonzero(places // s.batch == k)
            z = x[at] @ w.T
            g = ((1 / (1 + np.exp(-z)) - y[at]).T @ x[at]) / z.size
            out.append(("train", step + 1, loss(w, x[at], y[at])[0], float(np.linalg.norm(g))))
            g = g * min(1, s.clip / (np.linalg.norm(g) + 1e-6)) if np.linalg.norm(g) > s.clip else g
            up = (step + 1) / warm if step < warm else 1.0 if step < total - tail else 0.5 * (1 + np.cos(np.pi * (step - total + tail) / tail))
            step += 1
            m, v = s.betas[0] * m + (1 - s.betas[0]) * g, s.betas[1] * v + (1 - s.betas[1]) * g * g
            w = w * (1 - s.rate * up * s.weight_decay)
            w = w - s.rate * up * (m / (1 - s.betas[0] ** step)) / (np.sqrt(v / (1 - s.betas[1] ** step)) + s.eps)
            if step % s.val_every == 0 or step == total:
                got = loss(w, vx, vy)
                out.append(("validation", step, *got))
                if got[0] < best[0]:
                    best = (got[0], step, w.copy())
    return out, w, best


def test_training_equals_a_run_in_numpy(spark, monkeypatch):
    monkeypatch.setattr(training, "FAN", 2)
    monkeypatch.setattr(training, "PER_PART", 16 * 8 * 8 // 4)  # several parts a batch, so sums go through a tree
    (x, y), (vx, vy) = made(45), made(12, 3)
    s = training.Settings(batch=16, epochs=2, rate=0.3, log_every=1, val_every=2, clip=0.05, weight_decay=0.1)
    head = training.fit_head(frame(spark, x, y), frame(spark, vx, vy), TARGETS, s)
    order = []
    for e in (1, 2):
        order.append(np.array([r.p for r in spark.range(45).select("id", permuted(F.col("id"), 45, s.seed + e).alias("p")).orderBy("id").collect()]))
    want, w, best = by_numpy(order, x, y, vx, vy, s)
    got = [(e["event"], e["step"], e["loss"], e.get("grad_norm", e.get("mae"))) for e in head.events]
    assert [g[:2] for g in got] == [k[:2] for k in want] and np.allclose([g[2:] for g in got], [k[2:] for k in want])
    assert np.allclose(head.weights, w) and np.allclose(head.best, best[2]) and head.best_step == best[1]
    rates = [e["learning_rate"] for e in head.events if e["event"] == "train"]
    assert rates == pytest.approx([0.3 * X.learning_rate_at(k, 6, 0.05, 0.2) for k in range(1, 7)])


def test_small_batches_run_in_spans_over_rows_stored_once(spark, tmp_path, monkeypatch):
    """Jobs, and readings of the validation rows' source, must not grow with the number of steps."""
    (x, y), (vx, vy) = made(1000), made(12, 3)
    s = training.Settings(batch=16, epochs=2, rate=0.3, log_every=1, val_every=2, clip=0.05, weight_decay=0.1)

    def noted(batches):
        for b in batches:
            with open(tmp_path / "read", "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    held = frame(spark, vx, vy)
    held = held.mapInArrow(noted, held.schema)
    train = frame(spark, x, y)
    spark.sparkContext.setJobGroup("spans", "training")
    head = training.fit_head(train, held, TARGETS, s)
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("spans")) < 63 * 2  # steps
    assert sum(map(int, (tmp_path / "read").read_text().split())) == 12
    order = [np.array([r.p for r in spark.range(1000).select("id", permuted(F.col("id"), 1000, s.seed + e).alias("p")).orderBy("id").collect()]) for e in (1, 2)]
    want, w, best = by_numpy(order, x, y, vx, vy, s)
    got = [(e["event"], e["step"], e["loss"], e.get("grad_norm", e.get("mae"))) for e in head.events]
    assert [g[:2] for g in got] == [k[:2] for k in want] and np.allclose([g[2:] for g in got], [k[2:] for k in want])
    assert np.allclose(head.weights, w) and np.allclose(head.best, best[2]) and head.best_step == best[1]
    assert head.events[-1]["eta_seconds"] == 0
    # batches of rows that end anywhere, and spans of any number of steps, change nothing
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(training, "SPAN", 5)
    other = training.fit_head(train.limit(200), held, TARGETS, s)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(training, "SPAN", 1)
    one = training.fit_head(train.limit(200), held, TARGETS, s)
    assert np.allclose(one.weights, other.weights) and one.best_step == other.best_step and len(one.events) == len(other.events)


def test_heads_of_a_span_are_validated_together_and_the_best_is_predicted_with(spark, tmp_path, monkeypatch):
    (x, y), (vx, vy) = made(300), made(12, 3)
    s, calls, sums = training.Settings(batch=16, epochs=1, rate=0.5, val_every=2), [], training._sums
    monkeypatch.setattr(training, "_sums", lambda *a: calls.append(1) or sums(*a))
    head = training.fit_head(frame(spark, x, y), frame(spark, vx, vy), TARGETS, s)
    assert len(calls) == 1  # of 19 steps and 10 validations
    order = [np.array([r.p for r in spark.range(300).select("id", permuted(F.col("id"), 300, s.seed + 1).alias("p")).orderBy("id").collect()])]
    _, _, (_, step, w) = by_numpy(order, x, y, vx, vy, s)
    training.save_head(spark, head, str(tmp_path / "head"))
    again = training.load_head(spark, str(tmp_path / "head"))
    got = {r.row_id: r.probs for r in training.predict(frame(spark, vx, vy), again).collect()}
    assert again.best_step == step and np.allclose([got[3 * k] for k in range(12)], 1 / (1 + np.exp(-vx @ w.T)), atol=1e-6)


def test_spans_end_by_bytes_and_not_after_a_few_steps(spark, monkeypatch):
    (x, y), (vx, vy) = made(1000), made(12, 3)
    s, calls, span = training.Settings(batch=16, epochs=1, rate=0.5, val_every=2), [], training._span
    monkeypatch.setattr(training, "_span", lambda *a: calls.append(a[5]) or span(*a))
    one = training.fit_head(frame(spark, x, y), frame(spark, vx, vy), TARGETS, s)
    assert calls == [63]  # steps of each span
    calls.clear()
    monkeypatch.setattr(training, "PER_PART", 40 * 16 * 8 * 8)  # 40 batches
    other = training.fit_head(frame(spark, x, y), frame(spark, vx, vy), TARGETS, s)
    assert calls == [40, 23] and np.allclose(one.best, other.best) and one.best_step == other.best_step


def test_validation_rows_of_head_queries_are_chosen_once(spark, tmp_path, monkeypatch):
    def noted(batches):
        for b in batches:
            with open(tmp_path / "chosen", "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    def sample(*a):
        found = hash_sample(*a)
        return found.mapInArrow(noted, found.schema)

    hash_sample = registry.split.hash_sample
    monkeypatch.setattr(registry.split, "hash_sample", sample)
    rows = registry._head_rows(spark, "/root/testdata/sf0.001")
    n = [rows.where(w).count() for w in ("true", "held is null", "held")]
    assert n[0] == n[1] + n[2] and n[2] == round(n[0] / 10) == sum(map(int, (tmp_path / "chosen").read_text().split()))


def test_soft_labels_are_learned_and_heads_are_kept(spark, tmp_path):
    (x, y), (vx, vy) = made(300), made(60, 3)
    rows = frame(spark, x, y).unionByName(spark.createDataFrame([(1, None, [0.0] * 3), (2, [1.0] * 5, None), (4, [1.0] * 5, [None, 0.1, 0.2])], "row_id long, vector array<double>, targets array<double>"))
    run = runlog.claim_run(spark, str(tmp_path))
    head = training.fit_head(rows, frame(spark, *made(300)), TARGETS, training.Settings(batch=100, epochs=6, rate=0.3, val_every=4, log_every=4), runlog.Log(spark, run))
    assert head.best_mae < 0.12 and head.best_loss < head.events[0]["loss"]
    path = str(tmp_path / "head")
    assert training.save_head(spark, head, path) == "v0"
    again = training.load_head(spark, path)
    assert np.array_equal(again.best, head.best) and (again.best_step, again.best_loss, again.targets) == (head.best_step, head.best_loss, TARGETS)
    got = {r.row_id: r.probs for r in training.predict(frame(spark, vx, vy), again).collect()}
    assert np.allclose([got[3 * k] for k in range(60)], 1 / (1 + np.exp(-vx @ head.best.T)), atol=1e-6)
    log = runlog.read(spark, run, "event string, step long, loss double, time string, eta_seconds double").orderBy("nth").collect()
    assert [(r.event, r.step, r.loss) for r in log] == [(e["event"], e["step"], e["loss"]) for e in head.events] and log[0].time and log[-1].eta_seconds == 0
    versions.commit(versions.read(spark, path).where("dimension <> 2"), path, "v0")
    with pytest.raises(ValueError, match="whole"):
        training.load_head(spark, path)


def test_refusals(spark):
    x, y = made(5)
    none = frame(spark, x, y).where("false")
    with pytest.raises(ValueError, match="no training rows"):
        training.fit_head(none, none, TARGETS)
    mixed = frame(spark, x, y).unionByName(spark.createDataFrame([(99, [1.0], [0.1] * 3)], "row_id long, vector array<double>, targets array<double>"))
    with pytest.raises(Exception, match="one size"):
        training.fit_head(mixed, none, TARGETS, training.Settings(epochs=1))
    head = training.fit_head(frame(spark, x, y), none, TARGETS, training.Settings(epochs=1))
    assert head.best_step == 1 and np.array_equal(head.best, head.weights)


def test_schedule_on_driver_and_in_columns(spark):
    for total in (1, 10, 1000):
        got = [r.m for r in spark.range(total).select(X.learning_rate(F.col("id"), total, 0.05, 0.2).alias("m")).collect()]
        assert got == pytest.approx([X.learning_rate_at(k, total, 0.05, 0.2) for k in range(total)])


def test_runs_of_one_second(spark, tmp_path):
    now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    runs = [runlog.claim_run(spark, str(tmp_path), now) for _ in range(3)]
    assert [r.rsplit("/", 1)[1] for r in runs] == ["run_20260102_030405_utc", "run_20260102_030405_utc_2", "run_20260102_030405_utc_3"]
    log = runlog.Log(spark, runs[0])
    log.add({"a": "é"})
    log.flush()
    log.flush()
    other = runlog.Log(spark, runs[0])  # goes on behind what is there
    other.add({"a": "y", "b": 2})
    other.flush()
    assert [(r.nth, r.a, r.b) for r in runlog.read(spark, runs[0], "a string, b int").orderBy("nth").collect()] == [(0, "é", None), (1, "y", 2)]
