"""Relational, hierarchical and annotation operators on DataFrames."""
