"""Column patterns and distributed statistics that Spark has no built-in for."""
