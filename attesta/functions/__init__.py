"""Column expressions: text, numbers, cards, paths."""
