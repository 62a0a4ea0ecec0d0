"""Statements and key-value operations as Spark plans."""
