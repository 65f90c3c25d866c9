"""Relational and retrieval operators over DataFrames."""
