import json
import os

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as S
from loomspark.operators import corpus, progressive
from loomspark.sources import shards, versions

NONE = "digest string"


def write_shards(spark, path, files=12, rows=10):
    """Shards by name; file k holds texts of 5 words, every fourth a copy of one in the first file, every fifth too short."""
    for k in range(files):
        texts = [("a b c d " + (str(r) if r % 4 == 0 else f"{k}-{r}")) if r % 5 else "short" for r in range(rows)]
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{path}/s{k:02}")


def damage(path, first):
    for k in range(first, 12):
        for name in os.listdir(f"{path}/s{k:02}"):
            if name.endswith(".parquet"):
                with open(f"{path}/s{k:02}/{name}", "wb") as f:
                    f.write(b"not parquet")
            elif name.endswith(".crc"):
                os.unlink(f"{path}/s{k:02}/{name}")


def banned(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(S.digest(F.col("t")).alias("digest"))


def test_files_behind_the_target_are_not_opened(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_shards(spark, src)
    no = banned(spark, "a b c d 0-1", "a b c d 1-2")
    source = corpus.with_text_keys(shards.read_shards(spark, shards.list_files(spark, src, ".parquet"), ["text"]), F.col("text"))
    want = {t: sorted((r.row_id, r.text) for r in corpus.build(source, no, 3, 9, t).collect()) for t in (30, 31, 100)}
    why = {r.reason: r.documents for r in corpus.rejections(source, no, 3, 9, 100).collect()}
    damage(src, 6)  # no more can be read
    for t in (30, 31, 100):
        got = progressive.build(spark, src, out, no, 3, 9, t, overwrite=True)
        assert sorted((r.row_id, r.text) for r in got.collect()) == want[t]
    state = versions.state(spark, out)
    assert state["files"] <= 6 and state["tokens"] == 100 == sum(r.token_count for r in got.collect())
    assert {k: state[k] for k in why} == why
    with pytest.raises(Exception, match="(?i)parquet"):
        progressive.build(spark, src, out, no, 3, 9, 10_000, resume=True)


def test_resume_and_refusals(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_shards(spark, src)
    no = banned(spark, "a b c d 0-1")
    whole = {r.row_id for r in progressive.build(spark, src, str(tmp_path / "one"), no, 3, 9, 200).collect()}
    part = progressive.build(spark, src, out, no, 3, 9, 200, most_groups=1)
    assert 0 < part.count() < len(whole)
    with pytest.raises(ValueError, match="resume or overwrite"):
        progressive.build(spark, src, out, no, 3, 9, 200)
    with pytest.raises(ValueError, match="low"):
        progressive.build(spark, src, out, no, 2, 9, 200, resume=True)
    with pytest.raises(ValueError, match="exclusions"):
        progressive.build(spark, src, out, banned(spark, "x"), 3, 9, 200, resume=True)
    got = progressive.build(spark, src, out, no, 3, 9, 200, resume=True)
    assert {r.row_id for r in got.collect()} == whole
    at = versions.version(spark, out)
    progressive.build(spark, src, out, no, 3, 9, 200, resume=True)  # nothing is left to do
    assert versions.version(spark, out) == at
    with pytest.raises(ValueError, match="ends at"):
        progressive.build(spark, src, out, no, 3, 9, 10_000, resume=True)
    state = versions.state(spark, out)
    assert state["files"] == 12 and state["rows"] == 120 and sum(state[k] for k in progressive.COUNTS) == 120 == state["next"]
    for bad in ({"files": -1}, {"files": 13}, {"tokens": "7"}, {"rows": True}):
        versions.commit(None, out, versions.version(spark, out), state=state | bad)
        with pytest.raises(ValueError, match="damaged"):
            progressive.build(spark, src, out, no, 3, 9, 200, resume=True)


def test_repair_refills_or_restores(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_shards(spark, src)
    progressive.build(spark, src, out, banned(spark, "none"), 3, 9, 100)
    new = banned(spark, "a b c d 0-1", "a b c d 0-2")
    before = versions.version(spark, out)
    assert progressive.repair(spark, src, out, banned(spark, "other"), 3, 9, 100) == 0 and versions.version(spark, out) == before
    assert progressive.repair(spark, src, out, new, 3, 9, 100) == 2
    fixed = versions.read(spark, out)
    assert corpus.audit(fixed, new).first().excluded_documents == 0 and fixed.agg(F.sum("token_count")).first()[0] == 100
    assert fixed.groupBy("digest").count().where("count > 1").isEmpty()
    source = corpus.with_text_keys(shards.read_shards(spark, shards.list_files(spark, src, ".parquet"), ["text"]), F.col("text"))
    held = sorted(r.row_id for r in fixed.collect())
    assert held == sorted(r.row_id for r in corpus.build(source, new, 3, 9, 100).collect())
    damage(src, 0)
    with pytest.raises(Exception, match="(?i)parquet"):
        progressive.repair(spark, src, out, banned(spark, "a b c d 0-3", "a b c d 1-1"), 3, 9, 100)
    assert sorted(r.row_id for r in versions.read(spark, out).collect()) == held


def test_jsonl_prefix(spark, tmp_path):
    for k in range(6):
        lines = ["" if r == 2 else json.dumps({"i": k * 10 + r}) for r in range(5)]
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "f5.jsonl").write_text("nope\n")  # fails when it is read
    path = str(tmp_path)
    for n, want in ((0, []), (3, [0, 1, 3]), (4, [0, 1, 3, 4]), (6, [0, 1, 3, 4, 10, 11])):
        got = progressive.read_jsonl_prefix(spark, path, n).select("row_id", F.try_variant_get("value", "$.i", "int").alias("i")).orderBy("row_id").collect()
        assert [r.i for r in got] == want and [r.row_id for r in got] == list(range(n))
    with pytest.raises(Exception, match="not a JSON object"):
        progressive.read_jsonl_prefix(spark, path, 100).collect()
    assert progressive.read_jsonl_prefix(spark, path, 100, "skip").count() == 20
    with pytest.raises(ValueError, match="no file"):
        progressive.read_jsonl_prefix(spark, path + "/none", 3)
