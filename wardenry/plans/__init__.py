"""Batch jobs composed of operators, and the queries bound to the provided tables."""
