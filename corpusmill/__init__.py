"""Corpus analytics expressed as plain Spark DataFrame functions."""
