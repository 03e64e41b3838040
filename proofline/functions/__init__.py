"""Column functions: patterns, redaction, command classes, clauses."""
