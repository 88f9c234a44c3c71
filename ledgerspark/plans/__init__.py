"""Queries composed from operators, and the views over the test tables."""
