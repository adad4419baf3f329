"""Null, empty, long and repeated rows, empty tables and clashing columns, for each pipeline stage."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, html_extract, ngram_join

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A = " ".join(f"w{k}" for k in range(60))
NEAR_A = A + " end"
B = " ".join(f"v{k}" for k in range(40))
C = " ".join(f"u{k}" for k in range(40))
LONG = " ".join(f"z{k}" for k in range(60_000))
ROWS = [
    (1, A, "en", "s", len(A)),
    (None, NEAR_A, None, None, None),  # near copy of 1 without an id
    (None, B, None, "s", len(B)),
    (None, B + " end", "en", "s", None),  # near copy of a text without an id
    (2, C, "en", None, len(C)),
    (2, C, "en", None, len(C)),  # repeated row
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)),
]


def test_near_copies_without_an_id(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("component_id", F.lit("mine")).withColumn("__key", F.lit(1))
    got = ngram_join.similar_documents(df, k=5, part=80, whole=100).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        [(1, 56, 1), (-1, 57, 1), (-1, 36, -1), (-1, 37, -1), (2, 36, 2), (2, 36, 2), (3, 0, 3), (4, 0, 4), (-1, 0, -1), (5, 59_996, 5)]
    )


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit("mine")).withColumn("epoch", F.lit(9)).withColumn("kept", F.lit(0))
    want = {
        "toxicity": 10,
        "ngram_join": 8,  # two near copies go, one of them of a text without an id
        "substring_dedup": 8,
    }
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF)
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        rows = after.collect()
        if name in want:
            assert len(rows) == want[name], name
        if name == "ngram_join":
            texts = [r.text for r in rows]
            assert A in texts and NEAR_A not in texts and texts.count(C) == 2 and LONG in texts
            assert (B in texts) != (B + " end" in texts)
        if name == "mixing":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None}
        docs = after if name == "bpe" else after.withColumn("score", F.lit("mine")).withColumn("n_tokens", F.lit("mine")).withColumn("place", F.lit("mine"))
    decoded = {r.doc_id: r.decoded for r in bpe.decode(docs).collect()}
    assert decoded[3] == decoded[4] == "" and decoded[5] == LONG


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_columns_of_the_same_name_are_replaced(spark):
    pages = spark.createDataFrame([(None, None, "<article><p>Some words.</p></article>", 7), (1, "u", None, 8)], "page_id long, url string, html string, text int")
    assert [r.text for r in html_extract.extract(pages).collect()] == ["Some words.", ""]
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(docs)).first()
    assert got.decoded == "a b" and 4 * got.n_tokens == len(got.ids)
