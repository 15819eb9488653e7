"""Column functions: text, vectors."""
