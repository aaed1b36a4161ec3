"""Column expressions and the few numeric helpers Spark has no built-in for."""
