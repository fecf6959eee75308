"""Catalog of runnable queries and the SQL they are checked against."""
