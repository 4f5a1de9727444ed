"""Column expressions: labels, reply parsing, statistics."""
