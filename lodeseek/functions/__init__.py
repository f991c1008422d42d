"""Column-building functions: vectors, text, chunking, hashing, formatting."""
