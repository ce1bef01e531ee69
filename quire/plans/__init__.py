"""Logical tables and the registered queries."""
