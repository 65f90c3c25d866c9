"""Talweg: ranked retrieval and document analytics as Spark plans."""
