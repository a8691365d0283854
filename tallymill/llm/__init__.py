"""Operators for preparing training data. Nothing outside this folder and ``corpus_pipeline.py`` imports them."""
