"""Operators for preparing training corpora, each a Spark job over whole tables."""
