"""Operators for large training-data pipelines (see ``queries.py`` for the registered queries)."""
