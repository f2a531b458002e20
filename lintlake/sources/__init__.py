"""Readers and writers: tables, source trees, planted corpora and report sinks."""
