"""Loomshift: a PySpark engine for schema-to-schema migration analytics."""
