"""Operators for training-data pipelines: truncation, pair defects, splitting, page noise,
near-duplicates, corpus encoding, evaluation leakage and offensive content.

Nothing outside this subpackage imports it.
"""
