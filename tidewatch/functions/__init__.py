"""Column functions: text, math, hashes."""
