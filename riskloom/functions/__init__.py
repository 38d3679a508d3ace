"""Column expressions: features, decisions, message texts."""
