import corpus_pipeline as cp
import test_ngram_join
import test_repeats
from loomspark.llm import bpe


def test_stages_on_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES:
        after = stage(spark, before, sf)
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        ids, kept = ({r.doc_id for r in d.select("doc_id").collect()} for d in (before, after))
        assert kept <= ids
        if name in ("substring_dedup", "mixing", "bpe"):
            assert kept == ids
        if name != "bpe":
            assert after.columns == docs.columns
        if name == "mixing":
            count = after.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
            assert count <= 2
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "ngram_join":
            groups = test_ngram_join.brute(rows, 5, 80, 100)
            assert kept == {i for i, (_, c) in groups.items() if i == c}
        if name == "substring_dedup":
            left = test_repeats.brute(rows, str.split, 13, " ".join)
            want = {i: k if gone else t for (i, t), (_, gone, _, k) in zip(rows, left)}
            assert {r.doc_id: r.text for r in after.collect()} == want
        before = after
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in bpe.decode(before).collect():
        assert r.decoded == (texts[r.doc_id] or "")
