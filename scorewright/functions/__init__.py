"""Column expressions and small value objects used by the operators."""
