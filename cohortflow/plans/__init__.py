"""Compositions of operators: preparation, retrieval and evaluation flows."""
