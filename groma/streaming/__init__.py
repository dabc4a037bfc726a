"""Structured Streaming forms of the ordered folds."""
