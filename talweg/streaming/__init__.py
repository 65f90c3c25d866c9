"""The query-set pipeline over micro-batches."""
