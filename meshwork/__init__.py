"""Structural graph clustering and table operators as plain Spark DataFrame code."""
