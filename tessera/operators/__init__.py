"""Operators over DataFrames: search, chunking, indexing, sessions, routing, ledger, recall, catalog."""
