"""Operators on construction plans."""
