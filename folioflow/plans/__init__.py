"""Whole jobs built from the operators, and the named queries over the given tables."""
