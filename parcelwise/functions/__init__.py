"""Column expressions: text, geography and scoring."""
