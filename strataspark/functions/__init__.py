"""Column expressions: labels, colour indices, conversions."""
