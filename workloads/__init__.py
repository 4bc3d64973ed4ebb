"""Queries over the test tables, each with equivalent SQL to check it against."""
