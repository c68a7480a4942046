"""Catalog search, resource processing and corpus preparation on PySpark."""
