"""Queries composed from the operators, each with SQL to check it against."""
