"""Corpus curation, rating and scoring jobs written as Spark DataFrame programs."""
