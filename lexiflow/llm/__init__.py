"""Operators of a training-data pipeline.  Nothing outside this folder, its
tests, ``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py``
uses it."""
