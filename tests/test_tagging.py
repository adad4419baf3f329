import json
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import scoring, tagging
from loomspark.sources import versions

TARGETS = ["f::m0", "f::m1", "g::m0", "g::m1"]


def made():
    def load():
        return lambda texts: [[len(t) / 100, (len(t) % 7) / 7, 0.5, 1.0] for t in texts]

    return load


load = made()


def greedy(lengths, limit):
    ends, held = [], 0
    for k, n in enumerate(lengths):
        if held and (held + 1) * n > limit:
            ends.append(k)
            held = 0
        held += 1
    return [*ends, len(lengths)] if lengths else []


def docs(spark, n=60, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, "x" * rng.randint(0, 40), rng.choice([None, *range(30)])) for k in range(n)], "row_id long, text string, token_count long")


def test_packs_are_greedy():
    rng = random.Random(4)
    for limit in (1, 10, 64, 1000):
        for n in (0, 1, 5, 300):
            lengths = sorted(rng.choice([1, 2, 3, 50, 2000]) for _ in range(n))
            assert tagging.pack_ends(np.array(lengths, np.int64), limit) == greedy(lengths, limit)


@pytest.mark.parametrize("records", [3, 10_000])
def test_packs_go_over_arrow_batches(spark, records):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        batched = scoring.length_batches(docs(spark), 16)
        got = tagging.score_packed(batched, load, 4, 60, most_tokens=25).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = {r.row_id: r for r in batched.collect()}
    assert len(got) == 60 and all(r.probs == pytest.approx(load()([rows[r.row_id].text])[0]) for r in got)
    for b in range(4):
        mine = sorted((min(25, max(1, rows[r.row_id].token_count or 0)), r.row_id, r) for r in got if r.batch == b)
        ends = greedy([x for x, _, _ in mine], 60)
        for p, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)):
            for _, _, r in mine[lo:hi]:
                assert (r.pack, r.pack_rows, r.padded_tokens) == (p, hi - lo, (hi - lo) * mine[hi - 1][0])
    with pytest.raises(Exception, match="must give 4"):
        tagging.score_packed(batched, lambda: lambda texts: [[0.5]] * len(texts), 4).collect()


def test_a_run_that_stops_goes_on(spark, tmp_path):
    source, home = docs(spark), str(tmp_path / "run")
    whole = {r.row_id: r.probs for r in tagging.run(source, str(tmp_path / "one"), load, "m", TARGETS, 7, per_wave=3).collect()}
    assert sorted(whole) == list(range(60)) and tagging.finished(spark, str(tmp_path / "one"))
    part = tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3, most_waves=1)
    assert part.count() in (18, 21) and not tagging.finished(spark, home)

    def breaks():
        raise KeyError

    with pytest.raises(Exception, match="KeyError"):
        tagging.run(source, home, breaks, "m", TARGETS, 7, per_wave=3, resume=True)
    assert versions.state(spark, f"{home}/scores")["completed_waves"] == 1
    for bad in ({"model_name": "other"}, {"targets": TARGETS[:2]}, {"size": 8}, {"seed": 9}, {"first_row": 1}, {"source": source.where("row_id > 0")}, {"source": source.withColumn("token_count", F.lit(3).cast("long"))}):
        args = {"source": source, "model_name": "m", "targets": TARGETS, "size": 7} | bad
        with pytest.raises(ValueError, match="other settings"):
            tagging.run(home=home, load=load, per_wave=3, resume=True, **args)
    with pytest.raises(ValueError, match="resume or overwrite"):
        tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3)
    with pytest.raises(ValueError, match="no run"):
        tagging.run(source, str(tmp_path / "none"), load, "m", TARGETS, 7, resume=True)
    good, scores = versions.state(spark, f"{home}/scores"), f"{home}/scores"
    for damage in ({"completed_waves": 4}, {"completed_waves": -1}, {"completed_waves": "1"}, {"waves": 5}, {"completed_waves": True}):
        versions.commit(None, scores, versions.version(spark, scores), state=good | damage)
        with pytest.raises(ValueError, match="damaged"):
            tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3, resume=True)
    versions.commit(None, scores, versions.version(spark, scores), state=good)
    shutil.rmtree(f"{home}/rows/wave=0")  # waves that are done aren't read again
    assert {r.row_id: r.probs for r in tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3, resume=True).collect()} == whole
    assert {r.row_id: r.probs for r in tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3, overwrite=True).collect()} == whole
    tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3, overwrite=True, most_waves=1)
    shutil.rmtree(f"{home}/rows/wave=2")
    with pytest.raises(ValueError, match="wave 2 are gone"):
        tagging.run(source, home, load, "m", TARGETS, 7, per_wave=3, resume=True)
    some = tagging.run(source, str(tmp_path / "tail"), load, "m", TARGETS, 7, first_row=50)
    assert sorted(r.row_id for r in some.collect()) == list(range(50, 60))


def test_a_wave_reads_its_own_files_alone(spark, tmp_path):
    home = str(tmp_path)
    tagging.run(docs(spark, 200), home, load, "m", TARGETS, 10, per_wave=2, most_waves=0)
    sizes = {w: sum(os.path.getsize(f"{home}/rows/{w}/{f}") for f in os.listdir(f"{home}/rows/{w}")) for w in os.listdir(f"{home}/rows") if w.startswith("wave=")}
    assert len(sizes) == 10
    one = spark.read.parquet(f"{home}/rows/wave=3")
    assert one.count() == 20 and all("/wave=3/" in f for f in one.inputFiles()) and sizes["wave=3"] < sum(sizes.values()) / 5


def saved(spark, home):
    """Finished waves of each version of a run."""
    scores = f"{home}/scores"
    return [versions.state(spark, scores, f"v{v}")["completed_waves"] for v in range(int(versions.version(spark, scores)[1:]) + 1)]


def test_short_waves_share_a_job(spark, tmp_path, monkeypatch):
    source, home = docs(spark, 120), str(tmp_path / "run")
    monkeypatch.setattr(tagging, "SPAN", 1e6)
    whole = {r.row_id: r.probs for r in tagging.run(source, home, load, "m", TARGETS, 3, per_wave=1).collect()}
    assert saved(spark, home) == [0, 1, 5, 21, 40] and sorted(whole) == list(range(120))
    assert versions.state(spark, f"{home}/scores")["documents"] == 120
    tagging.run(source, str(tmp_path / "part"), load, "m", TARGETS, 3, per_wave=1, most_waves=7)
    assert saved(spark, str(tmp_path / "part")) == [0, 1, 5, 7]
    shutil.rmtree(f"{tmp_path}/part/rows/wave=15")  # those before it are scored
    with pytest.raises(ValueError, match="wave 15 are gone"):
        tagging.run(source, str(tmp_path / "part"), load, "m", TARGETS, 3, per_wave=1, resume=True)
    assert saved(spark, str(tmp_path / "part"))[4:] == [8, 12, 15]
    monkeypatch.setattr(tagging, "SPAN", 0.0)  # waves that take longer
    slow = tagging.run(source, str(tmp_path / "slow"), load, "m", TARGETS, 3, per_wave=1, most_waves=4)
    assert saved(spark, str(tmp_path / "slow")) == [0, 1, 2, 3, 4] and {r.row_id: r.probs for r in slow.collect()}.items() <= whole.items()


def test_spans_follow_the_time_that_waves_take():
    assert [tagging.next_span(1, s) for s in (0, 1.5, tagging.SPAN / 2, tagging.SPAN, 1e9)] == [4, 4, 2, 1, 1]
    assert tagging.next_span(100, 40.0) == 75 and tagging.next_span(100, 1e6) == 1


def test_a_run_keeps_the_waves_before_one_that_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tagging, "SPAN", 1e6)
    source, home = docs(spark, 120), str(tmp_path / "run")
    whole = {r.row_id: r.probs for r in tagging.run(source, str(tmp_path / "whole"), load, "m", TARGETS, 3, per_wave=1).collect()}
    assert not os.path.exists(f"{tmp_path}/whole/rows")  # nothing reads them any more
    tagging.run(source, home, load, "m", TARGETS, 3, per_wave=1, most_waves=0)
    shutil.copytree(f"{home}/rows/wave=17", f"{tmp_path}/good")
    bad = spark.read.parquet(f"{home}/rows/wave=17").withColumn("text", F.lit("bad")).localCheckpoint()
    bad.write.mode("overwrite").parquet(f"{home}/rows/wave=17")

    def picky():
        def model(texts):
            if "bad" in texts:
                raise KeyError("bad")
            return load()(texts)

        return model

    with pytest.raises(Exception, match="KeyError"):
        tagging.run(source, home, picky, "m", TARGETS, 3, per_wave=1, resume=True)
    assert saved(spark, home)[-1] == 17
    shutil.rmtree(f"{home}/rows/wave=17")
    shutil.copytree(f"{tmp_path}/good", f"{home}/rows/wave=17")
    assert {r.row_id: r.probs for r in tagging.run(source, home, picky, "m", TARGETS, 3, per_wave=1, resume=True).collect()} == whole


def test_tags_are_written_in_source_order(spark, tmp_path):
    source = docs(spark)
    scores = spark.createDataFrame([(k, [0.25, 0.5, k / 64, 1.0]) for k in range(60)], "row_id long, probs array<float>")
    path = str(tmp_path / "out")
    tagging.write_in_order(tagging.tagged(source, scores, TARGETS).repartition(7), path, 5)
    lines = [json.loads(x) for f in sorted(os.listdir(path)) if f.endswith(".json") for x in open(f"{path}/{f}")]
    want = [{"text": r.text, "token_count": r.token_count, "tags": {"f": {"m0": 0.25, "m1": 0.5}, "g": {"m0": r.row_id / 64, "m1": 1.0}}} for r in source.orderBy("row_id").collect()]
    assert lines == want
    for bad, match in (([0.1, 0.2, 0.3, 1.5], "not a probability"), ([0.1], "other targets"), (None, "no scores"), ([0.1, 0.2, 0.3, float("nan")], "not a probability"), ([0.1, 0.2, 0.3, None], "not a probability")):
        one = scores.where("row_id <> 3").unionByName(spark.createDataFrame([(3, bad)], scores.schema))
        with pytest.raises(Exception, match=match):
            tagging.tagged(source, one, TARGETS).collect()
    with pytest.raises(ValueError, match="tags column"):
        tagging.tagged(source.withColumn("tags", F.lit(1)), scores, TARGETS)


def test_rows_meet_their_scores_in_the_ranges_of_the_files(spark, tmp_path):
    source = docs(spark).repartition(7)
    scores = spark.createDataFrame([(k, [0.25, 0.5, k / 64, 1.0]) for k in range(59, -1, -1)], "row_id long, probs array<float>")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    tagging.write_in_order(tagging.tagged(source, scores, TARGETS), one, 5)
    tagging.write_tagged(source.select("row_id", "text"), scores.join(source.select("row_id", "token_count"), "row_id"), TARGETS, two, 5)
    lines = [[x for f in sorted(os.listdir(p)) if f.endswith(".json") for x in open(f"{p}/{f}")] for p in (one, two)]
    assert lines[0] == lines[1] and len(lines[0]) == 60
    for bad, match in (([0.1, 0.2, 0.3, 1.5], "not a probability"), ([0.1], "other targets"), (None, "no scores")):
        less = scores.where("row_id <> 3").unionByName(spark.createDataFrame([(3, bad)], scores.schema))
        with pytest.raises(Exception, match=match):
            tagging.write_tagged(source, less, TARGETS, str(tmp_path / match))
    with pytest.raises(ValueError, match="tags column"):
        tagging.write_tagged(source.withColumn("tags", F.lit(1)), scores, TARGETS, str(tmp_path / "no"))
