"""Column expressions: tokens, patterns and formatting."""
