"""Column functions (pure expressions, no UDF)."""
