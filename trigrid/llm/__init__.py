"""Operators for large training-data pipelines: similarity, clusters, term counts, packing, leakage, repetition."""
