"""Licence scan with a positional index of rare licence words (DataFrame functions only).

Templates are short licence passages. Their words form a positional index:
word -> (template, position). It holds the words of each template's mandatory
key phrase that are rarest in the corpus (highest inverse document frequency),
as many as an alignment needs votes. They are looked up at every place of each
document, and postings that agree on the relative position of a template vote
for an alignment. An alignment counts if the key phrase stands where the
alignment puts it, word for word; so each place of a key phrase gets its votes,
whatever else the document holds. Three plain phrases are counted wherever they
stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels that always count.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Fixed values: (label, passage, mandatory key phrase within it).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc", "this work is licensed under a creative commons attribution license", "creative commons"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
]
VOTES = 2  # postings that must agree on an alignment; no key phrase has fewer words
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _at(words: Column, start: Column, phrase: list[str]) -> Column:
    """Do the phrase's words stand from index ``start`` on?"""
    test = start >= 0
    for k, w in enumerate(phrase):
        test = test & F.coalesce(F.get(words, start + k) == w, F.lit(False))
    return test


def _places(words: Column, every: Column, phrase: list[str], label: str) -> Column:
    starts = F.filter(every, lambda i: _at(words, i, phrase))
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def _key_start(passage: str, key: str) -> int:
    """Index of the key phrase's first word within the passage."""
    p, q = passage.split(), key.split()
    return next(k for k in range(len(p)) if p[k : k + len(q)] == q)


def word_weights(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word, over all documents.

    The result has one number for each distinct template word, so it is small
    whatever the corpus.
    """
    vocabulary = sorted({w for _, passage, _ in TEMPLATES for w in passage.split()})
    words = F.split(F.translate(F.col(text), _UPPER, _LOWER), _CUT)
    found = docs.select(F.explode(F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary)))).alias("word"))
    seen = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    from math import log

    return {w: log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}


def scan(docs: DataFrame, text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with the licence columns.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` of the base phrases
    (the two null if there are none); ``base_labels`` and ``labels``, distinct,
    sorted and comma-joined ("" if none); ``score``, the largest share of a
    template's words that a verified alignment finds in place, and at least 0.5
    with a base phrase; ``matches``, the verified (label, word) pairs. Null and
    empty texts have no words. Input columns with these names are replaced.
    """
    weights = word_weights(docs, text) if weights is None else weights
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, passage, key) in enumerate(TEMPLATES):
        start, p = _key_start(passage, key), passage.split()
        rarest = sorted(range(start, start + len(key.split())), key=lambda k: (-weights[p[k]], p[k], k))
        for k in rarest[:VOTES]:
            postings.setdefault(p[k], []).append((t, k))
    index = F.create_map(*(x for w, found in postings.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in found)))))
    # A document without one of these has neither a base phrase nor a key phrase.
    needed = {max(key.split(), key=lambda w: (weights.get(w, 0), w)) for key in [*BASE, *(k for _, _, k in TEMPLATES)]}
    body = F.coalesce(F.col(text), F.lit(""))

    def verified(words: Column) -> Column:
        looked_up = F.filter(F.transform(words, lambda w, i: F.struct(F.try_element_at(index, w).alias("q"), i.alias("i"))), lambda x: x.q.isNotNull())
        hits = F.flatten(F.transform(looked_up, lambda x: F.transform(x.q, lambda q: F.struct(q.t.alias("t"), (x.i - q.p).alias("at")))))

        def checked(h: Column) -> Column:
            def tried(c: Column) -> Column:
                cases = []
                for t, (label, passage, key) in enumerate(TEMPLATES):
                    p = passage.split()
                    start = _key_start(passage, key)
                    share = sum((F.coalesce(F.get(words, c.at + k) == w, F.lit(False)).cast("int") for k, w in enumerate(p)), F.lit(0)) / len(p)
                    ok = _at(words, c.at + start, key.split())
                    cases.append((t, F.when(ok, F.struct(F.lit(label).alias("label"), (c.at + start).cast("long").alias("word"), share.cast("double").alias("share")))))
                out = F.lit(None)
                for t, case in cases:
                    out = F.when(c.t == t, case).otherwise(out)
                return out

            def first_with_votes(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(h, i + VOTES - 1) == x, F.lit(False)) & ((i == 0) | (F.get(h, i - 1) != x))

            return F.filter(F.transform(F.filter(h, first_with_votes), tried), lambda m: m.isNotNull())

        return _let(F.array_sort(hits), checked)

    def places(words: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(words) - 1)
        found = []
        for phrase, label in BASE.items():
            found.append(_places(words, every, phrase.split(), label))
        return F.concat(*found)

    def licence(words: Column) -> Column:
        return F.struct(places(words).alias("base"), verified(words).alias("matches"))

    words = F.array_remove(F.split(F.translate(body, _UPPER, _LOWER), _CUT), "")
    candidate = body.rlike("(?i)" + "|".join(sorted(needed)))
    found = F.when(candidate & (F.regexp_count(body, F.lit(_WORD)) > 0), _let(words, licence))
    new = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"}
    kept = [c for c in docs.columns if c not in new]
    step = docs.select(*kept, F.regexp_count(body, F.lit(_WORD)).cast("long").alias("n_words"), found.alias("__l"))
    base, matches = F.col("__l.base"), F.col("__l.matches")
    base_labels = F.coalesce(F.array_distinct(F.transform(base, lambda b: b.label)), F.array().cast("array<string>"))
    more = F.coalesce(F.transform(matches, lambda m: m.label), F.array().cast("array<string>"))
    n = F.coalesce(F.size(base), F.lit(0))
    n = F.when(F.col("__l").isNull(), 0).otherwise(n).cast("long")
    return step.select(
        *kept,
        "n_words",
        n.alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["at"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(matches, lambda m: m.share)), F.lit(0.0)), F.when(n > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce(matches, F.array().cast("array<struct<label:string,word:bigint,share:double>>")).alias("matches"),
    )


def op7_licence_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text", "matches")
