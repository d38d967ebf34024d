"""Training-data operators: near-duplicates, filters, classifiers, tokenizers, search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
