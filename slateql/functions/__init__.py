"""Predicates and literal typing, compiled to column expressions."""
