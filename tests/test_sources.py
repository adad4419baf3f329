import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as X
from loomspark.functions import text as S
from loomspark.operators import agreement, corpus, ratings, scoring
from loomspark.sources import jsonl, shards


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("a", 1000), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"i": k}) if k % 7 else "" for k in range(n)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = jsonl.with_row_id(jsonl.read_jsonl(spark, str(tmp_path))).select("file", "line", "row_id", F.try_variant_get("value", "$.i", "int").alias("i")).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.line == r.i + 1 for r in rows)
    assert [r.row_id for r in rows] == list(range(len(rows)))
    assert [(r.file[-7:], r.i) for r in rows] == [(f"{f}.jsonl", k) for f, n in (("a", 1000), ("b", 300)) for k in range(n) if k % 7]
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, str(tmp_path), blank_lines=False).collect()


def test_shards_keep_their_order(spark, tmp_path):
    for k, name in enumerate("abc"):
        spark.range(k * 100, k * 100 + 100, 1, 1).select(F.col("id").alias("text"), F.lit(1).alias("other")).write.parquet(str(tmp_path / name))
    rows = shards.read_shards(spark, str(tmp_path / "*"), ["text"]).collect()
    assert len(rows) == 300 and all(r.row_id == r.text for r in rows)
    with pytest.raises(ValueError, match="token_count"):
        shards.read_shards(spark, str(tmp_path / "a"), ["text", "token_count"])
    found = shards.first_usable([lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.range(0), lambda: spark.range(3)])
    assert found.count() == 3
    with pytest.raises(ValueError, match="source 0 is empty"):
        shards.first_usable([lambda: spark.range(0)])


def test_ranks_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(corpus, "RANGE", 10)
    rows = [(k, ["f", "g", None][k % 3], [None, 1.5, 2.5, 2.5][k % 4]) for k in range(200)]
    got = agreement.ranked(spark.createDataFrame(rows, "row_id long, filter string, mean double"), "mean").collect()
    for f in ("f", "g", None):
        mine = sorted((r for r in got if r.filter == f), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.row_id, r.mean) for r in mine] == sorted(((i, m) for i, g, m in rows if g == f), key=lambda x: (-(x[1] if x[1] is not None else -1), x[0]))


def test_running_sum_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(corpus, "RANGE", 5)
    rows = spark.range(300).select((F.col("id") * 3).alias("row_id"), F.col("id").alias("v"))
    got = {r.row_id: r.cum for r in corpus.running_sum(rows, "v").collect()}
    assert got == {3 * k: k * (k + 1) // 2 for k in range(300)}


def test_message_text_and_payload(spark):
    cases = [("plain", "plain"), (["a", {"text": "b"}, {"text": "", "content": "c"}, {"content": "d"}, {"text": 5}, 7], "a\nb\nc\nd"), ([], ""), ({"text": "x"}, ""), (None, "")]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(cases)], "i int, j string")
    got = {r.i: r.t for r in df.select("i", S.message_text(F.parse_json("j")).alias("t")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
    made = json.loads(spark.range(1).select(S.payload(F.lit("m"), F.lit('a "b"\n'), "be strict", 100, "low").alias("p")).first().p)
    assert made == {"model": "m", "messages": [{"role": "system", "content": "be strict"}, {"role": "user", "content": 'a "b"\n'}], "max_tokens": 100, "reasoning": {"enabled": True, "effort": "low", "exclude": True}}


def test_durations_and_means(spark):
    rows = [(3725.9, "01:02:06"), (0.5, "00:00:00"), (1.5, "00:00:02"), (-3.0, "00:00:00"), (None, "--:--:--"), (float("inf"), "--:--:--"), (float("nan"), "--:--:--"), (400_000.0, "111:06:40")]
    for r in spark.createDataFrame(rows, "s double, w string").select("w", X.duration(F.col("s")).alias("d")).collect():
        assert r.d == r.w
    r = spark.range(1).select(X.time_left(F.lit(10.0), F.lit(4), F.lit(12)).alias("a"), X.time_left(F.lit(10.0), F.lit(0), F.lit(12)).alias("b"), X.mean_text(F.lit(7.0)).alias("c"), X.mean_text(F.lit(2.25)).alias("d"), X.mean_text(F.lit(None).cast("double")).alias("e")).first()
    assert (r.a, r.b, r.c, r.e) == (20.0, None, "7", "-") and r.d == "2.3"


def test_legacy_ratings_alignment_and_order(spark):
    long = spark.createDataFrame([(1, "f", "m", 3.0, 0), (2, "g", "m", 4.0, 0)], "row_id long, filter string, model string, rating double, pos long")
    old = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 11.0), (4, None)], "row_id long, rating double")
    assert sorted((r.row_id, r.filter, r.model, r.rating) for r in ratings.promote_legacy(long, old, "f", "old").collect()) == [(1, "f", "m", 3.0), (2, "f", "old", 8.0), (2, "g", "m", 4.0)]
    source = spark.createDataFrame([(0, "a", 1), (1, None, 2), (2, "c", 3)], "row_id long, text string, n int")
    output = spark.createDataFrame([(0, "a", 1, "t"), (1, None, 2, "t"), (2, "c", 4, "t"), (9, "z", 1, "t")], "row_id long, text string, n int, tags string")
    assert sorted(r.row_id for r in corpus.misaligned(output, source).collect()) == [2, 9]
    assert sorted(r.row_id for r in corpus.misaligned(output, source, ["text"]).collect()) == [9]
    assert corpus.extended(output.where("row_id = 0"), source, 2).count() == 2
    errors = spark.createDataFrame([("f", "b", 1.0), ("f", "a", 1.0), ("f", "c", None), ("f", "d", 0.5)], "filter string, model string, mae_human double")
    assert [r.model for r in agreement.models_by_error(errors).orderBy("place").collect()] == ["d", "a", "b", "c"]


def test_layout_and_linear_head(spark):
    assert scoring.layout_of(["f::a", "g::a::b", "f::c", "g::c"][:1]) == [(0, "f", "a")]
    for bad in ([], ["f"], ["::a"], ["f::a", "f::a"], ["f::a", "g::b"], ["f::a", "f::b", "g::b", "g::a"]):
        with pytest.raises(ValueError):
            scoring.layout_of(bad)
    rows = [([1.0, x], 1.0 if x > 0 else 0.0) for x in (-2.0, -1.0, 1.0, 2.0)] + [(None, 1.0)]
    w = scoring.fit_linear_head(spark.createDataFrame(rows, "vector array<double>, target double"), 2, steps=20)
    assert w[1] > 1 and abs(w[0]) < 1e-9
    assert scoring.fit_linear_head(spark.createDataFrame([], "vector array<double>, target double"), 2) == [0.0, 0.0]
