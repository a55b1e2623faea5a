"""Training-data operators: tokens, cleaning, duplicates, quality, mixing, search.

Every operator takes a DataFrame of documents and column names and returns a
DataFrame. Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
