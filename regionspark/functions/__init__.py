"""Column expressions and window helpers used by the operators."""
