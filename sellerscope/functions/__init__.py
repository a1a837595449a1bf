"""Column expressions and small distributed algorithms shared by operators."""
