"""Operators for training-data pipelines: packing, sharding, language, toxicity, deduplication, token counts, page text.

Nothing outside this folder imports it, except ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
