"""Column functions: text keys, numbers, geometry, similarity."""
