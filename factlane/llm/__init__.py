"""Training-data operators: scans, filters, deduplication, scoring, mixing.

Nothing outside this package, its tests and ``corpus_pipeline.py`` imports it.
"""
