"""Column expressions and scale-out building blocks."""
