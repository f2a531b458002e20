"""Registered queries over the core operators."""
