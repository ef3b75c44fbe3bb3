"""Operators of a training-data pipeline: language id, scoring, deduplication, mixing, tokenising, formatting.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
