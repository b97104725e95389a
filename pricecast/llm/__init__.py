"""Training-data operators: mixing, near-duplicate search, scans, cleaning, formatting.

Nothing outside this folder (besides ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) depends on it.
"""
