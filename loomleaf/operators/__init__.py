"""Relational operators: windows over ordered blocks, sets and bags, package relations, checks."""
