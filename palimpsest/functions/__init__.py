"""Column functions: vectors, text, scoring, security."""
