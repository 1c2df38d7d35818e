"""A PySpark evidence engine: retrieval, extraction, graph and quality operators as DataFrame plans."""
