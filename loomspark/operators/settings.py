"""Settings of jobs, read from JSON and checked before anything runs. Every error names the setting."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomspark.sources import versions

_MISSING = object()


class Section:
    """An object of the settings and the name it goes by in errors."""

    def __init__(self, raw: Any, name: str):
        if not isinstance(raw, dict):
            raise ValueError(f"{name} must be an object")
        self.raw, self.name = raw, name

    def get(self, key: str, default: Any = _MISSING) -> Any:
        if key not in self.raw and default is _MISSING:
            raise ValueError(f"{self.name}.{key} is missing")
        return self.raw.get(key, default)

    def section(self, key: str) -> Section:
        return Section(self.get(key), f"{self.name}.{key}")

    def text(self, key: str) -> str:
        v = self.get(key)
        if not isinstance(v, str) or not v.strip():
            raise ValueError(f"{self.name}.{key} must be a text that isn't empty")
        return v

    def whole(self, key: str, least: int | None = 1, default: Any = _MISSING) -> int:
        v = self.get(key, default)
        if not isinstance(v, int) or isinstance(v, bool) or (least is not None and v < least):
            raise ValueError(f"{self.name}.{key} must be a whole number" + (f" of {least} or more" if least is not None else ""))
        return v

    def number(self, key: str, low: float, high: float, default: Any = _MISSING) -> float:
        """A number of ``low`` or more and under ``high``."""
        v = self.get(key, default)
        if not isinstance(v, (int, float)) or isinstance(v, bool) or not low <= v < high:
            raise ValueError(f"{self.name}.{key} must be a number of {low} or more and under {high}")
        return float(v)

    def texts(self, key: str) -> list[str]:
        """A list of different texts, one at least."""
        v = self.get(key)
        if not isinstance(v, list) or not v or not all(isinstance(x, str) and x.strip() for x in v):
            raise ValueError(f"{self.name}.{key} must be a list of texts that isn't empty")
        if len(set(v)) != len(v):
            raise ValueError(f"{self.name}.{key} names something twice")
        return v


def read(spark: SparkSession, path: str) -> Section:
    """The settings at ``path``, wherever that lies."""
    try:
        return Section(json.loads(versions.read_text(spark, path)), path)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} isn't JSON: {e}") from None


@dataclass(frozen=True)
class Build:
    source: str
    exclusions: tuple[str, ...]
    output: str
    target: int
    low: int
    high: int


def build(s: Section) -> Build:
    out = Build(s.text("source"), tuple(s.texts("exclusions")), s.text("output"), s.whole("target_tokens"), s.whole("min_tokens"), s.whole("max_tokens"))
    if out.low > out.high:
        raise ValueError(f"{s.name}.min_tokens is above max_tokens")
    if out.output in out.exclusions:
        raise ValueError(f"{s.name}.output is an exclusion too")
    return out


@dataclass(frozen=True)
class Tagging:
    source: str
    model: str
    batch_size: int
    seed: int


def tagging(s: Section) -> Tagging:
    return Tagging(s.text("source"), s.text("model"), s.whole("batch_size"), s.whole("batch_shuffle_seed", None, 42))


@dataclass(frozen=True)
class Rating:
    templates: dict[str, str]  # by filter, in order
    models: list[str]
    max_documents: int | None
    batch_size: int
    concurrent: int
    retries: int

    def layout(self, spark: SparkSession) -> DataFrame:
        """(idx, filter, model) of every pair, filters first."""
        pairs = [(f, m) for f in self.templates for m in self.models]
        return spark.createDataFrame([(k, f, m) for k, (f, m) in enumerate(pairs)], "idx int, filter string, model string")


def rating(s: Section) -> Rating:
    """Each filter's template must have a place for the document."""
    raw, templates = s.get("filters"), {}
    if not isinstance(raw, list) or not raw:
        raise ValueError(f"{s.name}.filters must be a list that isn't empty")
    for k, entry in enumerate(raw):
        one = Section(entry, f"{s.name}.filters[{k}]")
        name, template = one.text("name"), one.text("template")
        if name in templates:
            raise ValueError(f"{s.name}.filters names {name} twice")
        if "{document}" not in template:
            raise ValueError(f"{one.name}.template has no place for the document")
        templates[name] = template
    most = None if s.get("max_documents") is None else s.whole("max_documents")
    return Rating(templates, s.texts("models"), most, s.whole("batch_size"), s.whole("max_concurrent"), s.whole("max_retries"))


def upsampling(s: Section, filters: list[str], aliases: dict[str, str] | None = None) -> dict[str, int]:
    """Weights of all ``filters`` (1 where none are set); names may be aliases, each filter once."""
    if s.get("weights", None) is None:
        return dict.fromkeys(filters, 1)
    given, weights = s.section("weights"), {}
    for key in given.raw:
        name = (aliases or {}).get(key, key)
        if name not in filters:
            raise ValueError(f"{given.name} has no filter {key}")
        if name in weights:
            raise ValueError(f"{given.name} weights {name} twice")
        weights[name] = given.whole(key)
    missing = [f for f in filters if f not in weights]
    if missing:
        raise ValueError(f"{given.name} lacks {', '.join(missing)}")
    return weights
