"""Column functions: geometry, text and codes."""
