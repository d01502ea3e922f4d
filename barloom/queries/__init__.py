"""Registered queries, grouped as the operators are."""
