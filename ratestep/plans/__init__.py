"""Relational plans: bin tables and the recursions over them as DataFrame operations."""
