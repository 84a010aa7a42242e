"""Column expressions: no joins, no shuffles."""
