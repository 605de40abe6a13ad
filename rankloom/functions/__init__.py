"""Column functions: text, labels and vectors."""
