"""Fixtures shared with the rest of the tests; here only what the corpus operators add."""
