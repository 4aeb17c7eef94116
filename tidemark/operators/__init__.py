"""Operators over tables that hold many archive prefixes at once."""
