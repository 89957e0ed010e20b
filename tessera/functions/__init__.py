"""Column functions: text normalization, blocking keys, similarities."""
