"""Relational operators over findings, sources and parsed code."""
