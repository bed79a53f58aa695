"""Operators for large text corpora (training-data preparation).

Nothing outside this subpackage imports it. Each operator lives in its own module
with a general interface; ``registry`` holds the thin ``opN_`` queries.
"""
