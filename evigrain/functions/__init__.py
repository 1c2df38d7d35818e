"""Column functions: text, numbers, units, geography, vectors, query planning."""
