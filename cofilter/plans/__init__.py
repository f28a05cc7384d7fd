"""Whole queries: the test-table mapping, evaluations and the query catalog."""
