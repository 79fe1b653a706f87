"""Queries: named plans over the operators, each with SQL that says the same."""
