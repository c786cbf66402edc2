"""Column functions: text, hashes, vectors, rules."""
