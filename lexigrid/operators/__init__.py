"""Operators over DataFrames: chunking, graph algebra, entities, communities, retrieval."""
