"""Structured Streaming: findings of source versions as they arrive."""
