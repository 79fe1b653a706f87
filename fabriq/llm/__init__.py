"""Operators for large training-data corpora.  Nothing else in fabriq imports this subpackage."""
