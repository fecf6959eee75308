"""Spark jobs for outdoor photovoltaic reliability data."""
