"""Readers: packages, XML nodes, Markdown."""
