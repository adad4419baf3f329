import json
import os

import pytest
from pyspark.sql import functions as F

from loomspark.operators import matching, ratings, split
from loomspark.sources import jsonl


def test_annotations_get_the_live_text(spark):
    p = "p" * 200
    live = spark.createDataFrame([(0, p + "a"), (1, "x"), (2, "x"), (3, p + "b")], "row_id long, text string")
    hand = spark.createDataFrame([(10, "x", 1), (11, p + "b", 2), (12, p + "changed", 3)], "ann_id long, text string, label int")
    got = matching.synced(hand, live)
    assert sorted(map(tuple, got.collect())) == [(10, 1, "exact", "x", 1), (11, 3, "exact", p + "b", 2), (12, 0, "prefix", p + "a", 3)]
    assert tuple(matching.sync_counts(got).first()) == (2, 1)
    more = lambda *rows: hand.unionByName(spark.createDataFrame(rows, hand.schema))
    with pytest.raises(ValueError, match="without a live row: 13, 14"):
        matching.synced(more((13, "none", 1), (14, "", 1)), live)
    with pytest.raises(ValueError, match="several annotations: 1"):
        matching.synced(more((15, "x", 1)), live)


def test_live_rows_stay_aligned(spark, tmp_path):
    path = tmp_path / "live.jsonl"

    def write(*lines):
        path.write_text("\n".join(lines) + "\n")
        (tmp_path / ".live.jsonl.crc").unlink(missing_ok=True)
        return jsonl.read_live_rows(spark, str(path))

    got = write('{"text":"a","n":1}', '{"text":"b"}').orderBy("row_id").collect()
    assert [(r.row_id, r.text) for r in got] == [(0, "a"), (1, "b")]
    for bad in ("", '{"text":""}', '{"text":5}', "[]", "nope"):
        with pytest.raises(Exception, match="live.jsonl"):
            write('{"text":"a"}', bad, '{"text":"b"}').collect()
    path.write_text("")
    with pytest.raises(ValueError, match="no rows"):
        jsonl.read_live_rows(spark, str(path))


def test_json_lines_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    read = lambda: sorted(json.loads(x)["k"] for f in os.listdir(path) if f.endswith(".json") for x in open(f"{path}/{f}"))
    jsonl.replace_jsonl(spark.range(3).select(F.col("id").alias("k")), path)
    jsonl.replace_jsonl(spark.range(5).select(F.col("id").alias("k")), path)
    assert read() == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="stop"):
        jsonl.replace_jsonl(spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("stop"))).otherwise("x").alias("k")), path)
    assert read() == [0, 1, 2, 3, 4] and sorted(os.listdir(tmp_path)) == ["out"]


def test_ratings_are_only_added_to_containers(spark):
    df = spark.createDataFrame([(0, '{"ratings":{"f":[]}}'), (1, '{"ratings":{"f":"x"}}')], "row_id long, j string").select("row_id", F.parse_json("j").alias("value"))
    assert ratings.require_appendable(df.where("row_id = 0"), ["f"]).count() == 1
    assert ratings.require_appendable(df, ["g"]).count() == 2
    with pytest.raises(Exception, match="row 1"):
        ratings.require_appendable(df, ["f"]).collect()


def rated(spark, rows):
    """Documents t0, t1, ... with ratings by one filter and two models; None leaves one out."""
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(rows)], "row_id long, text string")
    long = [(k, "f", m, 0, float(r)) for k, (_, pair) in enumerate(rows) for m, r in zip("ab", pair, strict=True) if r is not None]
    return docs, spark.createDataFrame(long, "row_id long, filter string, model string, pos long, rating double")


def test_training_rows_are_disjoint_from_hand_rows(spark):
    layout = spark.createDataFrame([(0, "f", "a"), (1, "f", "b")], "idx int, filter string, model string")
    docs, long = rated(spark, [(f"t{k}", (k % 11, None if k == 5 else 1)) for k in range(40)] + [("h0", (9, 9)), ("h0", (9, 9))])
    hand, hand_long = rated(spark, [("h0", (3, 4)), ("h1", (5, None)), ("h2", (7, 8))])
    notes = spark.createDataFrame([(0, "h0", 1), (1, "h0", 0), (2, "h2", 0), (3, "t7", 1)], "ann_id long, text string, label int")
    x = split.prepare(docs, long, hand, hand_long, notes, layout, {"f": 3}, 0.1)
    n = {r.name: r.n for r in x.summary.collect()}
    # rows 5 (incomplete), 7 (a hand text) and 40 (the first of two copies of one) aren't trained on
    assert n == {"rated_rows": 42, "complete_rows": 41, "incomplete_rows": 1, "hand_rows": 3, "validation_hand_rows": 2, "excluded_overlap_rows": 2, "validation_sample_rows": 4, "validation_rows": 6, "unique_training_rows": 35, "training_rows": x.train.count(), "duplicate_copies": x.train.count() - 35, "upsampled_rows": x.train.where("copy = 3").count(), "unmatched_annotations": 1, "unusable_hand_rows": 2, "targets": 2}
    rows, held = {r.row_id for r in x.train.collect()}, x.validation.collect()
    assert not rows & {5, 7, 40} and not rows & {r.row_id for r in held if r.origin == "rated"} and len(rows) == 35
    assert {(r.row_id, tuple(r.targets)) for r in held if r.origin == "hand"} == {(0, (0.3, 0.4)), (2, (0.7, 0.8))}
    assert {(r.row_id, r.label) for r in x.labels.collect()} == {(0, 1), (2, 0)}
    none = long.where("false")
    with pytest.raises(ValueError, match="every rating"):
        split.prepare(docs, none, hand, hand_long, notes, layout, {})
    every = docs.select(F.col("row_id").alias("ann_id"), "text", F.lit(1).alias("label"))
    with pytest.raises(ValueError, match="hand document too"):
        split.prepare(docs, long.where("row_id < 3"), hand, hand_long, every, layout, {})
    with pytest.raises(ValueError, match="leave none"):
        split.prepare(docs, long.where("row_id < 2"), hand, hand_long, notes, layout, {}, 0.9)
