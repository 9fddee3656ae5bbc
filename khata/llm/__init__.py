"""Operators for training-data pipelines: screening, deduplication, tokenizing, sharding and fixity of text corpora.

Nothing outside this folder imports it, except the entry file and ``corpus_pipeline.py``.
"""
