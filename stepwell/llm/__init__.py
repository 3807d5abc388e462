"""Operators of a training-data pipeline over documents, pages and labels.

Nothing else in the library imports this subpackage.  ``queries`` binds the operators to
the given tables; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
