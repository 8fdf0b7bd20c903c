"""Operators bound to the tables as named queries, and the same queries as SQL."""
