"""Readers and writers: source trees, embedding responses, the vector index."""
