"""DataFrame-to-DataFrame operators, grouped by topic."""
