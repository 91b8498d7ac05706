"""Corpus-scale metadata hygiene on Spark: inspect and clean text, markup and binary files."""
