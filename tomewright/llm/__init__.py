"""Training-data operators: one module per operator, their registered queries in ``queries``.

Nothing outside this subpackage (but for ``corpus_pipeline.py``) imports it.
"""
