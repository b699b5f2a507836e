"""Column expressions and name rules used by the operators."""
