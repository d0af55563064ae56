"""Operators for large-scale training-data pipelines (optional subpackage).

Nothing outside this folder imports it; ``queries.py`` lists its queries.
"""
