"""Relational operators over configuration facts: each takes and returns DataFrames."""
