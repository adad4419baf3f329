import json

import pytest

from loomspark.operators import settings

BUILD = {"source": "in", "exclusions": ["a", "b"], "output": "out", "target_tokens": 100, "min_tokens": 2, "max_tokens": 9}
RATING = {"filters": [{"name": "f", "template": "Rate {document}"}, {"name": "g", "template": "{document}?"}], "models": ["m", "n"], "max_documents": None, "batch_size": 8, "max_concurrent": 4, "max_retries": 2}


def s(raw):
    return settings.Section(raw, "job")


def test_build_settings(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"build": BUILD}))
    assert settings.build(settings.read(spark, str(tmp_path / "x.json")).section("build")) == settings.Build("in", ("a", "b"), "out", 100, 2, 9)
    for bad, match in (({"source": " "}, "job.source"), ({"exclusions": []}, "exclusions"), ({"exclusions": ["a", "a"]}, "twice"), ({"target_tokens": 0}, "target_tokens"), ({"target_tokens": True}, "target_tokens"), ({"target_tokens": 1.0}, "target_tokens"), ({"min_tokens": 10}, "above"), ({"output": "b"}, "exclusion too")):
        with pytest.raises(ValueError, match=match):
            settings.build(s(BUILD | bad))
    with pytest.raises(ValueError, match="job.output is missing"):
        settings.build(s({k: v for k, v in BUILD.items() if k != "output"}))
    (tmp_path / "y.json").write_text("{")
    with pytest.raises(ValueError, match="isn't JSON"):
        settings.read(spark, str(tmp_path / "y.json"))
    (tmp_path / "z.json").write_text("[]")
    with pytest.raises(ValueError, match="must be an object"):
        settings.read(spark, str(tmp_path / "z.json"))


def test_rating_and_tagging_settings(spark):
    r = settings.rating(s(RATING))
    assert [tuple(x) for x in r.layout(spark).orderBy("idx").collect()] == [(0, "f", "m"), (1, "f", "n"), (2, "g", "m"), (3, "g", "n")] and r.max_documents is None
    for bad, match in (({"filters": []}, "filters"), ({"filters": [{"name": "f", "template": "no place"}]}, "no place for"), ({"filters": RATING["filters"] * 2}, "twice"), ({"models": ["m", "m"]}, "twice"), ({"models": [1]}, "models"), ({"max_documents": 0}, "max_documents"), ({"max_retries": 0}, "max_retries")):
        with pytest.raises(ValueError, match=match):
            settings.rating(s(RATING | bad))
    assert settings.tagging(s({"source": "a", "model": "b", "batch_size": 3})) == settings.Tagging("a", "b", 3, 42)
    with pytest.raises(ValueError, match="batch_shuffle_seed"):
        settings.tagging(s({"source": "a", "model": "b", "batch_size": 3, "batch_shuffle_seed": "7"}))
    assert s({"x": 0}).number("x", 0, 1) == 0.0
    with pytest.raises(ValueError, match="under 1"):
        s({"x": 1}).number("x", 0, 1)


def test_upsampling_weights():
    assert settings.upsampling(s({}), ["f", "g"]) == {"f": 1, "g": 1}
    assert settings.upsampling(s({"weights": {"short": 3, "g": 2}}), ["f", "g"], {"short": "f"}) == {"f": 3, "g": 2}
    for bad, match in (({"h": 1, "f": 1, "g": 1}, "no filter h"), ({"f": 1}, "lacks g"), ({"f": 0, "g": 1}, "weights.f"), ({"short": 1, "f": 1, "g": 1}, "twice")):
        with pytest.raises(ValueError, match=match):
            settings.upsampling(s({"weights": bad}), ["f", "g"], {"short": "f"})
