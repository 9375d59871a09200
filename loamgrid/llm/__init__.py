"""Operators for training-data pipelines: one module each, queries in ``queries.py``.

Nothing outside this folder imports it, ``__spark_entry__`` and ``corpus_pipeline`` apart.
"""
