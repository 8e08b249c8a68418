"""Column expressions and the small Arrow UDFs the operators are made of."""
