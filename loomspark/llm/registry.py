"""Queries of the training-data operators, each with SQL where SQL expresses it."""

from __future__ import annotations

from loomspark.llm import bpe, collocations, embedding_dedup, fingerprints, html_extract, licences, lm_score, mixing, ngram_join, spelling, substring_dedup, suffix_dedup, toxicity

_ALL = (
    mixing.op1_mixing,
    ngram_join.op2_ngram_join,
    substring_dedup.op3_substring_dedup,
    html_extract.op4_html_extraction,
    suffix_dedup.op5_suffix_array_dedup,
    toxicity.op6_toxicity,
    licences.op7_licence_scan,
    fingerprints.op8_fingerprints,
    bpe.op9_bpe,
    embedding_dedup.op10_embedding_dedup,
    spelling.op11_spelling_variants,
    collocations.op12_collocations,
    lm_score.op13_lm_score,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_suffix_array_dedup": suffix_dedup.OP5_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
