"""Column functions: text, values, keys."""
