"""Operators for training-data pipelines; their queries are in ``queries``.

Nothing is imported here, so that a Python worker loads only the operator it runs.
"""
