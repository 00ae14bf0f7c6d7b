"""Data governance on Spark DataFrames: checks, masking, audit, lineage, erasure, metrics, tenancy."""
