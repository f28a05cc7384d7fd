"""Operators: ordering, indexing, matrix, products, neighbourhood models,
factor models, ranking, metrics, profiling and set operations."""
