"""Column expressions: lenient parsing, market calendar."""
