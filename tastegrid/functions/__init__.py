"""Column expressions: hashing, text, numeric and vector helpers."""
