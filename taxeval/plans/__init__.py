"""Bindings of tables, queries and their SQL."""
