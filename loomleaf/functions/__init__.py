"""Column functions: text, characters, numbers."""
