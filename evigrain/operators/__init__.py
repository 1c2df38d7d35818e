"""Operators on DataFrames: ranking, graph, extraction, chunking, state, quality."""
