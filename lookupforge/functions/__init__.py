"""Column functions: id arithmetic, vectors."""
