"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; it may be deleted together with
``tests/llm`` and ``corpus_pipeline.py`` without touching the rest.
"""
