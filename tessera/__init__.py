"""Tessera: retrieval memory and session analytics on PySpark."""
