"""Operators on the two tables of a graph, each a plain DataFrame transformation."""
