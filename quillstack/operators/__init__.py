"""Relational operators over nodes, sections and references."""
