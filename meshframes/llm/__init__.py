"""Training-data operators. Nothing outside this subpackage imports it (but ``__spark_entry__.py``,
behind an import check, and ``corpus_pipeline.py``, which counts as part of it)."""
