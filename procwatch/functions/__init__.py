"""Column expressions: bands, scores, text, ids, policy."""
