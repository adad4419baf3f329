import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as X
from loomspark.functions import text as S
from loomspark.operators import corpus, judge, matching, metrics, ratings, scoring, split, upkeep
from loomspark.sources import jsonl, versions


def test_normalize_like_python_split(spark):
    texts = ["a b", "a  b", "a\tb\n", "a\x1cb", "a\xa0b", "　x ", "", "   ", "a﻿b", "a\U0001f600b", "\x85a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.normalize(F.col("t")).alias("n"), S.token_count(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.n == " ".join(texts[r.i].split()) and r.c == len(texts[r.i].split())


def test_response_parser(spark):
    cases = [
        ("<rating>7</rating><explanation> ok </explanation><quote> q </quote>", (7, "ok", "q")),
        ("<rating>3</rating><rating>10</rating><explanation>a</explanation><explanation>b</explanation>", (10, "b", "")),
        ("<RATING>4</RATING><Explanation>1\r\n2\n3\n4</Explanation><quote></quote>", (4, "1\n2\n3", "")),
        ("<rating>11</rating><explanation>x</explanation>", None),
        ("<rating>10<explanation>x</explanation>", (10, "x", "")),
        ("<rating>5</rating><explanation>unclosed", (5, "unclosed", "")),
        ("<rating>5</rating>", None),
        ("<rating>5</rating><explanation></explanation>", (5, "", "")),
        ("<rating>7.5<explanation>x</explanation>", (7, "x", "")),
        ("<rating>7a<explanation>x</explanation>", None),
        ("<rating>6</rating><explanation>it says <quote>so</quote> here</explanation>", (6, "it says <quote>so</quote> here", "so")),
        ("<rating>6</rating><explanation>ends wrong</quote> rest", (6, "ends wrong", "")),
        ("nothing", None),
        ("<rating>5</rating><explanation>" + "x" * 1_000_000 + "</explanation>", (5, "x" * 1_000_000, "")),
    ]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "i int, t string")
    for r in df.select("i", S.parse_response(F.col("t")).alias("e")).collect():
        assert (tuple(r.e) if r.e else None) == cases[r.i][1], cases[r.i][0][:80]


def test_jsonl_policies_and_types(spark, tmp_path):
    lines = ['{"text":"a","token_count":3}', "", "nope", "[1]", '{"text":5,"token_count":3.0}', '{"text":"","token_count":true}', '{"token_count":"3"}', '{"text":"b","token_count":0}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "x.jsonl")
    rows = jsonl.read_jsonl(spark, path, "skip").select("line", jsonl.string_field("text", empty=False).alias("t"), jsonl.positive_int_field("token_count").alias("n")).orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 3), (5, None, None), (6, None, None), (7, None, None), (8, "b", None)]
    assert jsonl.read_jsonl(spark, path, "count").where("value is null").count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, path).collect()


def test_commit_refuses_a_changed_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.commit(spark.range(3), path) == "v0"
    assert versions.commit(spark.range(5), path, "v0") == "v1"
    assert versions.read(spark, path).count() == 5
    with pytest.raises(RuntimeError):
        versions.commit(spark.range(1), path, "v0")
    jsonl.write_jsonl(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":"é","b":null}'


def test_token_counts_have_an_upper_bound(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(f'{{"token_count":{n}}}' for n in (4294967295, 4294967296)))
    rows = jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl")).select("line", jsonl.positive_int_field("token_count").alias("n"))
    assert {r.line: r.n for r in rows.collect()} == {1: 4294967295, 2: None}


def test_annotations(spark, tmp_path):
    def write(*lines):
        (tmp_path / "h.jsonl").write_text("\n".join(lines))
        return jsonl.read_annotations(spark, str(tmp_path / "h.jsonl"), {"f": "a", "g": "b"})

    rows = write('{"text":"x","a":1,"b":true}', "", '{"text":"y","a":-1,"b":2.0}', '{"text":"z","a":"1"}').orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 1, None), (3, "y", None, None), (4, "z", None, None)]
    for bad in ('{"text":""}', '{"text":5}', "{}", "[]", "nope"):
        with pytest.raises(Exception, match="h.jsonl"):
            write('{"text":"x"}', bad).collect()
    with pytest.raises(ValueError, match="no rows"):
        write("")
    (tmp_path / "h.jsonl").write_text('{"text":"x"}\n\n{"text":"y"}')
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_annotations(spark, str(tmp_path / "h.jsonl"), {}, blank_lines=False).collect()


def test_batches_are_committed_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).select(F.col("id").alias("row_id"), F.lit(0).alias("n"))
    versions.commit(rows, path)
    at = upkeep.by_batches(rows.where("row_id % 2 = 0"), path, 2, lambda b: b.withColumn("n", F.lit(1)))
    assert at == "v3" and {r.row_id for r in versions.read(spark, path).where("n = 1").collect()} == {0, 2, 4, 6, 8}
    assert versions.read(spark, path, "v1").where("n = 1").count() == 2

    def breaks(batch):
        if batch.where("row_id = 5").count():
            raise KeyError
        return batch.withColumn("n", F.lit(2))

    with pytest.raises(KeyError):
        upkeep.by_batches(rows.where("row_id % 2 = 1"), path, 2, breaks)
    assert versions.read(spark, path).where("n = 2").count() == 2


def test_resumed_scoring(spark):
    batched = scoring.length_batches(spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("token_count")), 4)
    mark = upkeep.fingerprint(batched, model="m", seed=7)
    scored = batched.where("batch < 2").select("row_id")
    assert sorted(r.batch for r in upkeep.remaining(batched, scored, mark, upkeep.fingerprint(batched, model="m", seed=7)).collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="start again"):
        upkeep.remaining(batched, scored, mark, upkeep.fingerprint(batched, model="other", seed=7))


def test_overlays_count_annotations_and_find_the_last_text(spark):
    docs = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "row_id long, text string")
    hand = spark.createDataFrame([(10, "x"), (11, "x"), (12, "none")], "ann_id long, text string")
    long = spark.createDataFrame([(0, "f", "m")], "row_id long, filter string, model string")
    overlay = hand.select("ann_id", F.lit("f").alias("filter"), F.lit("m").alias("model"))
    got = ratings.overlay_stats(long, overlay, matching.match(hand, docs, exact_last=True).select("ann_id", "row_id")).first()
    assert (got.matched_rows, got.added_ratings, got.collisions) == (2, 1, 1)


def test_rating_validators_and_last_valid_wins(spark):
    e = lambda r, **k: {"model": "m", "rating": r, "explanation": "", "quote": ""} | k
    entries = [e(7), e(7.0), e(7.5), e(-1), e(11), e(True), e("7"), e(None), {"model": "m", "rating": 4}]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(entries)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = {r.i: (r.a, r.b) for r in df.select("i", X.rating_for_rater(F.col("v")).alias("a"), X.rating_for_training(F.col("v")).alias("b")).collect()}
    assert [got[k] for k in range(9)] == [(True, True), (False, True), (False, True), (False, False), (False, False), (False, False), (False, False), (False, False), (False, True)]
    rows = [(1, {"f": [e(2), e(9), e(11)], "g": [e(1)]}), (2, {"f": {"x": 1}, "g": [3, e(5)]}), (3, [1]), (4, None)]
    df = spark.createDataFrame([(i, json.dumps({"ratings": r})) for i, r in rows], "row_id long, j string").select("row_id", F.parse_json("j").alias("value"))
    long = ratings.explode_ratings(df, X.rating_for_rater)
    assert sorted((r.row_id, r.filter, r.rating) for r in long.collect()) == [(1, "f", 9.0), (1, "g", 1.0), (2, "g", 5.0)]
    assert {r.row_id: r.ratings["g"][0].rating for r in ratings.nest(long).collect()} == {1: 1.0, 2: 5.0}


def _docs(spark, tokens):
    return spark.createDataFrame([(k, n, f"d{k}") for k, n in enumerate(tokens)], "row_id long, token_count long, digest string")


@pytest.mark.parametrize("target,want", [(10, [0, 1]), (11, [0, 1, 2]), (3, [0]), (1000, [0, 1, 2, 3])])
def test_budget_hit_crossed_and_exhausted(spark, target, want):
    df = corpus.budget_prefix(_docs(spark, [4, 6, 5, 7]), target)
    assert sorted(r.row_id for r in df.collect()) == want
    if target == 1000:
        with pytest.raises(Exception, match="ends before"):
            corpus.require_reached(df, target).collect()


def test_build_resume_repair(spark):
    source, none = _docs(spark, [5] * 40), _docs(spark, [])
    full = corpus.build(source, none, 1, 9, 100)
    part = corpus.build(source, none, 1, 9, 50)
    assert {r.row_id for r in corpus.build(source, none, 1, 9, 100, kept=part).collect()} == {r.row_id for r in full.collect()}
    banned = source.where("row_id < 3")
    fixed = corpus.repair(full, source, banned, 1, 9, 100)
    assert corpus.verify_disjoint(fixed, banned).first().tokens == 100
    with pytest.raises(Exception, match="excluded documents"):
        corpus.verify_disjoint(full, banned).collect()
    with pytest.raises(ValueError, match="excluded documents"):
        corpus.build(source, banned, 1, 9, 100, kept=part)


def test_match_first_last_and_prefix(spark):
    p = "p" * 200
    rows = spark.createDataFrame([(0, p + "a"), (1, "x"), (2, "x"), (3, p + "b")], "row_id long, text string")
    hand = spark.createDataFrame([(10, "x"), (11, p + "b"), (12, p + "c"), (13, "none"), (14, "x")], "ann_id long, text string")
    got = {r.ann_id: (r.row_id, r.how) for r in matching.match(hand, rows).collect()}
    assert got == {10: (1, "exact"), 11: (3, "exact"), 12: (0, "prefix"), 13: (None, None), 14: (1, "exact")}
    assert {r.ann_id: r.row_id for r in matching.match(hand, rows, exact_last=True).collect()}[10] == 2
    assert sorted(r.row_id for r in matching.all_matches(hand, rows).collect()) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="row of their own"):
        matching.require_unique(matching.match(hand, rows)).collect()


def test_samples(spark):
    assert [split.sample_size(*x) for x in ((10, 0.25), (30, 0.05), (50, 0.05), (1, 0.1), (100, 0), (100, 1e-9))] == [2, 2, 2, 0, 0, 1]
    df = spark.range(500).select(F.col("id").alias("row_id"))
    assert split.hash_sample(df, 0.1, 3).count() == 50 and split.exact_sample(df, 0.1, 3).count() == 50


def test_metrics(spark):
    x = spark.createDataFrame([(800.0, 1.0), (-800.0, 0.3), (0.0, 0.0)], "x double, t double").select(X.bce_with_logits(F.col("x"), F.col("t")).alias("l"), X.sigmoid(F.col("x")).alias("s")).collect()
    assert [round(r.l, 6) for r in x] == [0.0, 240.0, 0.693147] and [r.s for r in x] == [1.0, 0.0, 0.5]
    log = spark.createDataFrame([(k, float(k % 5)) for k in range(4080, 4120)], "step long, loss double")
    got = {r.step: r.average for r in metrics.moving_average(log, "loss").collect()}
    assert len(got) == 40 and got[4100] == pytest.approx(sum(k % 5 for k in range(4085, 4101)) / 16)
    assert metrics.best_checkpoint(log).first().step == 4080
    assert spark.range(1).select(X.duration(F.lit(3725.9)).alias("d")).first().d == "01:02:06"


@pytest.mark.parametrize("size", [16, 5000])
def test_moving_average_with_gaps_and_series(spark, size):
    rows = [(name, apart * k, float(k * k % 97)) for name, apart in (("a", 5), ("b", 50), (None, 1)) for k in range(9000)]
    log = spark.createDataFrame(rows, "run string, step long, loss double").orderBy(F.xxhash64("step"))
    got = {(r.run, r.step): r.average for r in metrics.moving_average(log, "loss", size, series=["run"]).collect()}
    assert len(got) == len(rows)
    for name, apart in (("a", 5), ("b", 50), (None, 1)):
        total = [0.0]
        for k in range(9000):
            total.append(total[-1] + k * k % 97)
            low = max(0, k + 1 - size)
            assert got[name, apart * k] == pytest.approx((total[k + 1] - total[low]) / (k + 1 - low))
    one = {r.step: r.average for r in metrics.moving_average(log.where("run = 'a'").select("step", "loss"), "loss", size).collect()}
    assert one == {s: v for (name, s), v in got.items() if name == "a"}


def test_scores_tags_and_retries(spark):
    df = spark.createDataFrame([(k, "x" * k, k) for k in range(10)], "row_id long, text string, token_count long")
    p = scoring.score_with(df, lambda: lambda texts: [[len(t) / 10, 0.5] for t in texts], 2).collect()
    assert len(p) == 10 and all(len(r.probs) == 2 for r in p)
    bad = spark.createDataFrame([(1, "f", "m", 1.5)], "row_id long, filter string, judge string, p double")
    with pytest.raises(Exception, match="not a probability"):
        scoring.nest_tags(bad).collect()
    calls = spark.createDataFrame([(1, "f", "m", "ok"), (2, "f", "m", "bad")], "row_id long, filter string, model string, prompt string")

    def model(prompt, name):
        if prompt == "bad":
            raise ValueError
        return "<rating>1</rating><explanation>e</explanation>"

    got = {r.row_id: r.response for r in judge.ask(calls, model, retries=2, sleep=lambda s: None).collect()}
    assert got[2] is None and judge.parsed(judge.ask(calls, model, retries=1)).first().rating == 1.0


def test_stream_admits_each_text_once(spark, tmp_path):
    from loomspark.streaming.ingest import admitted

    src = str(tmp_path / "in")
    spark.sql("select 'a b' text, 2L token_count, timestamp '2026-01-01' arrived union all select 'a  b', 2L, timestamp '2026-01-01' union all select 'no', 2L, timestamp '2026-01-01' union all select 'c', 9L, timestamp '2026-01-01'").write.parquet(src)
    banned = spark.sql("select 'no' text").select(S.digest(F.col("text")).alias("digest"))
    s = spark.readStream.schema("text string, token_count long, arrived timestamp").parquet(src)
    q = admitted(s, banned, 1, 5).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kept").count() == 1
