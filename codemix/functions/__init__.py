"""Column expressions: text classes, tagging, tag sequences."""
