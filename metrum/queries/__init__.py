"""Registered queries: each operator on the given tables, with the same query as plain SQL where one exists."""
