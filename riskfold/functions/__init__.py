"""Column expressions and the helpers that keep plans distributed."""
