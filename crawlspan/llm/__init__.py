"""Training-data operators: one module per operator, thin registered queries in ``queries.py``.

Nothing outside this folder (but the guarded import in ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
